"""Prefix trie of conversations by preorder intervals.

Conversations are ranked in lexicographic order of their turns, so that the members of a node, all conversations that begin
with its turns, have ranks without a gap. Nodes in order of (first rank, depth) are in preorder, and a node's subtree ends
where the nodes end whose first rank is at most its last rank. Leaves and savings of subtrees are then differences of prefix
sums over the preorder. No conversation is held as a whole: a node is known by sums of hashes of its turns with their
places, and ranks are made from blocks of turns, then from blocks of names of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .scans import in_order, running

#: Turns, or names of blocks, in a block.
BLOCK = 64
#: Characters of the joined ids that one row carries to a node's hash.
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_chars) of each row of `conversations` (conv_id, turn, role, text): role and text, null as empty, in 16 bytes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, 16)
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("n_chars")).where("conv_id is not null")


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_chars): turns in order of turn, null first, and then of digest; place from 0."""
    rows = running(in_order(turns, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")).drop("turn"), key="conv_id")
    return rows.select("conv_id", F.col("within").alias("place"), "digest", "n_chars")


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like others: the first h turns of conversation c - c % span, then c's own after its first h; h is crc32(c) % most.

    From (conv_id, place, ..), (conv_id, place, part_of, ..) with the same further columns: order by part_of, place.
    """
    h, base = F.crc32(F.col("conv_id").cast("string")) % most, F.col("conv_id") - F.col("conv_id") % span
    own = turns.where(F.col("place") >= h).withColumn("part_of", F.lit(1))
    takers = turns.select("conv_id").distinct().select(F.col("conv_id").alias("taker"), base.alias("conv_id"), h.alias("h")).where("h > 0")
    lent = turns.where((F.col("conv_id") % span == 0) & (F.col("place") < most - 1)).join(takers, "conv_id").where("place < h")
    lent = lent.drop("conv_id", "h").withColumnRenamed("taker", "conv_id").withColumn("part_of", F.lit(0))
    return own.unionByName(lent)


def _blocks(rows: DataFrame, place: str, name: str) -> DataFrame:
    """(conv_id, block, names): runs of up to BLOCK names of a conversation."""
    block = F.floor(F.col(place) / BLOCK).cast("bigint")
    held = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(place, name))).alias("names"))
    return held.select("conv_id", "block", F.col(f"names.{name}").alias("names"))


def ranks(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, rank) for each of `convs`: the place in lexicographic order of its steps (conv_id, depth from 1, digest), a prefix first.

    Equal conversations have neighbouring ranks. Conversations of over BLOCK steps take a round for each power of BLOCK:
    equal blocks get one name, in order of their contents, and blocks of names are ranked as those of digests were.
    """
    blocks = stored(_blocks(steps.select("conv_id", (F.col("depth") - 1).alias("place"), "digest"), "place", "digest"), "blocks")
    while (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        equal = F.sha2(F.concat_ws(",", F.transform("names", lambda x: F.hex(x))), 256)
        named = running(in_order(blocks.withColumn("same", equal), "names", "conv_id", "block").drop("names"), key="same")
        named = named.select("conv_id", "block", (F.col("at") - F.col("within")).alias("name"))
        blocks = stored(_blocks(named, "block", "name"), "blocks")
    none = F.array().cast(dict(blocks.dtypes)["names"])
    whole = convs.join(blocks.drop("block"), "conv_id", "left").select("conv_id", F.coalesce("names", none).alias("names"))
    return running(in_order(whole, "names", "conv_id").drop("names")).select("conv_id", F.col("at").alias("rank"))


_NODE = ["a", "b", "depth"]
_JOINED = "a bigint, b bigint, depth bigint, head bigint, ids string"


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, in order of conv_id: their ids joined, in pieces of about CHUNK characters."""
    now, head, ids, size = None, 0, [], 0
    out: list[tuple] = []

    def flush() -> None:
        if ids:
            out.append((*now, head, ",".join(ids)))
            ids.clear()

    for batch in batches:
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
            if node != now or size > CHUNK:
                flush()
                now, head, size = node, conv, 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip((*_NODE, "head", "ids"), r)) for r in out], _SCHEMA)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip((*_NODE, "head", "ids"), r)) for r in out], _SCHEMA)


_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("head", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node and head: each node's hash, fed as they stream by."""
    now, said = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if node == now:
                said.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, said.hexdigest()))
            now, said = node, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(_HASHED.names, r)) for r in out], _HASHED)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_HASHED.names, (*now, said.hexdigest())))], _HASHED)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) from (a, b, depth, conv_id): the hash of the node's ids, ascending and joined by commas.

    Ids of a hot node are joined where the parts of a sort hold them, and its task reads them as a stream of pieces.
    """
    pieces = in_order(ends.select(*_NODE, "conv_id"), *_NODE, "conv_id").drop("part").mapInArrow(_join_ids, _JOINED)
    ordered = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "head")
    return ordered.mapInArrow(_hash_ids, "a bigint, b bigint, depth bigint, ends_sha256 string")


def _mixed(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("depth"), F.col("digest"))


def prefix_trie(steps: DataFrame, convs: DataFrame, *order: str) -> DataFrame:
    """The nodes of the trie over `convs` (conv_id, unique) whose turns are `steps` (conv_id, digest, n_chars, and the columns of `order`).

    Gives (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end),
    a row for each distinct sequence of first turns and for the root: the smallest member, turns, the parent's smallest
    member, members, children, childless nodes and savings in the subtree (with its top), the hash of the ids of the
    conversations that end there, the place in preorder and the place after the subtree's last node. Conversations
    without steps end at the root. Without conversations there is no node.
    """
    along = running(in_order(steps.select("conv_id", "digest", "n_chars", *order), "conv_id", *order).drop(*order), key="conv_id")
    along = along.select("conv_id", "part", "digest", "n_chars", (F.col("within") + 1).alias("depth")).withColumns({"x": _mixed(1), "y": _mixed(2)})
    along = running(along, key="conv_id", sums=("x", "y"))
    ordered = ranks(convs, along.select("conv_id", "depth", "digest"))
    lengths = along.groupBy("conv_id").agg(F.max("depth").alias("length"))
    ranked = stored(ordered.join(lengths, "conv_id", "left").withColumn("length", F.coalesce("length", F.lit(0))), "ranks")

    node = along.select("conv_id", F.col("upto_x").alias("a"), F.col("upto_y").alias("b"), "depth", F.col("before_x").alias("up_a"), F.col("before_y").alias("up_b"), "n_chars")
    node = node.join(ranked, "conv_id")
    zero = F.lit(0).cast("bigint")
    top = ranked.select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("depth"), F.lit(None).cast("bigint").alias("up_a"), F.lit(None).cast("bigint").alias("up_b"), zero.alias("n_chars"), "rank", "length")
    rows = stored(node.unionByName(top), "members")

    ends = end_hashes(rows.where("depth = length"))
    least = [F.min(c).alias(c) for c in ("conv_id", "up_a", "up_b", "n_chars")]
    nodes = rows.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), *least)
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    # Preorder: a conversation's row stands behind all nodes whose first rank is its own or less.
    saved, leaf = (F.col("n_convs") - 1) * F.col("n_chars"), (F.col("n_children") == 0).cast("bigint")
    marked = nodes.withColumns({"saved": saved, "leaf": leaf, "node": F.lit(1).cast("bigint")})
    marks = ranked.select(F.col("rank").alias("first"), F.lit((1 << 63) - 1).alias("depth"), zero.alias("saved"), zero.alias("leaf"), zero.alias("node"))
    walked = running(in_order(marked.unionByName(marks, allowMissingColumns=True), "first", "depth"), sums=("saved", "leaf", "node"))
    walked = stored(walked, "preorder")
    to_end = walked.where("node = 0").select(F.col("first").alias("last"), *(F.col(f"upto_{c}").alias(f"end_{c}") for c in ("saved", "leaf", "node")))
    whole = walked.where("node = 1").join(to_end, "last")
    parents = walked.where("node = 1").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(parents, ["up_a", "up_b", "depth"], "left").join(ends, _NODE, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end_leaf") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("before_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        F.col("before_node").alias("preorder"), F.col("end_node").alias("subtree_end"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text), as `prefix_trie` gives it.

    Null roles and texts are empty, a null turn comes first, equal turns go by the digest of role and text; repeated rows
    are turns of their own. Rows with a null conv_id are left out, other columns ignored; texts of any length are read as a
    whole, once, into a digest. An empty table gives an empty one.
    """
    turns = placed(turn_digests(conversations))
    turns = stored(turns, "turns")
    return prefix_trie(rebuilt(turns), turns.select("conv_id").distinct(), "part_of", "place")
