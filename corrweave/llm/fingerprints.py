"""SimHash document fingerprints and the permuted block tables that search them.

A document's terms are its word shingles of several lengths. Each term's 128-bit hash votes with its weight (its
shingle length's weight, once for each occurrence) for the signed bits; a bit is set where the votes for it win.
Two fingerprints within Hamming radius r agree in at least one of r + 1 blocks of bits, so r + 1 tables, each keyed by
one block moved to the front, find every pair within the radius by equality joins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bits import bit_counts, pack_bits
from .common import chunks, copied, cut, dealt, hot_keys, shuffle_width, small_batches, stored

BITS = 128
#: Shingle length in words: weight of a vote.
WEIGHTS = {2: 1, 5: 2}

_U = np.uint64


class _WordHashes(dict):
    """Word to 64-bit hash; forgets all at a bound, so that memory stays flat over any corpus."""

    MOST = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@functools.cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _shingle_hashes(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each k-word shingle of each document, and how many each has; with fewer words, the whole sequence."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    n = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    total = int(n.sum())
    at = np.repeat(starts, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    ends = np.repeat(starts + lengths, n)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    h = np.zeros(total, dtype=np.uint64)
    for j in range(k):
        h = h * _U(0x9E3779B97F4A7C15 | 1) + np.where(at + j < ends, padded[at + j], _U(j + 1))
    return np.stack([_mixed(h, 0x243F6A8885A308D3), _mixed(h, 0x13198A2E03707344)], axis=1), n


def fingerprint_array(texts: pa.Array, weights: dict[int, int]) -> list[str]:
    """32 hex digits for each text; texts without a word have all bits clear."""
    out: list[str] = []
    known = _word_hashes()
    for part in chunks(texts):
        words = [(t or "").lower().split() for t in part.to_pylist()]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        hashes = np.fromiter((known[x] for w in words for x in w), dtype=np.uint64, count=int(lengths.sum()))
        votes = np.zeros((len(words), BITS), dtype=np.int64)
        for k, weight in weights.items():
            terms, n = _shingle_hashes(hashes, lengths, k)
            votes += weight * (2 * bit_counts(terms, n) - n[:, None])
        out += [f"{int(hi):016x}{int(lo):016x}" for hi, lo in pack_bits(votes > 0)]
    return out


def fingerprint(text: Column, weights: dict[int, int] = WEIGHTS) -> Column:
    """The text's 128-bit SimHash as 32 hex digits. Null, empty and blank texts have 32 zeros; equal texts are equal."""

    @arrow_udf("string")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_array(texts, weights), pa.string())

    return simhash(text)


def _word(fp: Column, i: int) -> Column:
    """The i-th 32 bits as a number."""
    return F.conv(F.substring(fp, 1 + 8 * i, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return functools.reduce(Column.__add__, (F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(BITS // 32)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - hamming(a, b) / F.lit(float(BITS))


def neighbours(queries: DataFrame, table: DataFrame, radius: int = 3) -> DataFrame:
    """All (query, match, distance) of distinct fingerprints within the radius, equal ones included.

    Both frames have a column `fingerprint`; null ones take no part and repeated ones count once. A pair that meets in
    several block tables is told by the first of them alone. Radius 0 to 31.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        bounds = [round(i * BITS / 4 / (radius + 1)) for i in range(radius + 2)]
        keys = F.array(*[F.substring(name, a + 1, b - a) for a, b in zip(bounds, bounds[1:])])
        one = df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        return one.select(name, keys.alias(f"{name}_blocks"), F.posexplode(keys).alias("block", "bits"))

    met = blocks(queries, "query").join(blocks(table, "match"), ["block", "bits"])
    equal = F.zip_with("query_blocks", "match_blocks", lambda a, b: a == b)
    first = F.array_position(equal, True) - 1 == F.col("block")
    distance = hamming(F.col("query"), F.col("match"))
    return met.where(first).select("query", "match", distance.alias("distance")).where(F.col("distance") <= radius)


#: Fingerprints of one block key beyond which the key is split by the blocks of what is left of them.
LONG_BLOCK = 4096


def _block_bounds(size: int, parts: int) -> list[int]:
    return [round(i * size / parts) for i in range(parts + 1)]


def block_rows(prints: DataFrame, radius: int, long: int = LONG_BLOCK) -> DataFrame:
    """(table, key, high, low) of distinct `fingerprint`s: each in radius + 1 tables, keyed by the block that the table has in front.

    A key that many fingerprints share is split: of the bits behind its block, cut into radius + 1 blocks too, one is equal
    in both of a pair, so each row goes into a table for each of them. table is the block, or for split keys block + 32 *
    (1 + the second block). Keys are hashes; who compares their fingerprints loses nothing by a collision.
    """
    bounds = _block_bounds(BITS // 4, radius + 1)
    blocks = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(bounds, bounds[1:])]
    rests = [F.concat(F.substring("fingerprint", 1, a), F.substring("fingerprint", b + 1, BITS // 4 - b)) for a, b in zip(bounds, bounds[1:])]
    halves = [F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("bigint").alias(name) for at, name in ((1, "high"), (17, "low"))]
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), block).alias("key"), rest.alias("rest")) for i, (block, rest) in enumerate(zip(blocks, rests))])
    rows = prints.select(*halves, F.inline(tables))
    # As a table of known size, so that the rows are not shuffled to join a few keys.
    many = stored(rows.groupBy("key").count().where(F.col("count") > long).select(F.col("key").alias("long_key")), "long-blocks")
    marked = rows.join(many, F.col("key") == F.col("long_key"), "left")

    def second(i: int, table: Column, key: Column, rest: Column) -> Column:
        a, b = (F.floor(F.length(rest) * n / (radius + 1)).cast("int") for n in (i, i + 1))
        return F.struct((table + 32 * (1 + i)).alias("table"), F.xxhash64(key, F.lit(i), F.substring(rest, a + 1, b - a)).alias("key"))

    split = F.array(*[second(i, F.col("table"), F.col("key"), F.col("rest")) for i in range(radius + 1)])
    whole = F.array(F.struct("table", "key"))
    return marked.select("high", "low", F.inline(F.when(F.col("long_key").isNull(), whole).otherwise(split))).select("table", "key", "high", "low")


def _masks(radius: int) -> dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each table of `block_rows`: the blocks before its own, and the second blocks before its own, as masks of both halves."""
    digits = BITS // 4

    def halves(places: list[int]) -> tuple[int, int]:
        whole = sum(0xF << 4 * (digits - 1 - d) for d in places)
        return whole >> 64, whole & (1 << 64) - 1

    bounds, out = _block_bounds(digits, radius + 1), {}
    blocks = [list(range(a, b)) for a, b in zip(bounds, bounds[1:])]
    for i, block in enumerate(blocks):
        rest = [d for d in range(digits) if d not in block]
        seconds = [rest[len(rest) * j // (radius + 1) : len(rest) * (j + 1) // (radius + 1)] for j in range(radius + 1)]
        out[i] = ([halves(x) for x in blocks[: i + 1]], [])
        for j in range(radius + 1):
            out[i + 32 * (1 + j)] = ([halves(x) for x in blocks[: i + 1]], [halves(x) for x in seconds[: j + 1]])
    return out


def _run_counts(masks: tuple, radius: int, high: np.ndarray, low: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """For each fingerprint of one key the others within the radius that this table tells: those whose first equal block, and second one, is its own."""
    n, out = len(high), np.zeros(len(high), np.int64)
    rows = max(1, step // n)
    for at in range(0, n, rows):
        x, y = high[at : at + rows, None] ^ high, low[at : at + rows, None] ^ low
        near = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= radius
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        for group in masks:
            for i, (m, k) in enumerate(group):
                equal = ((x & _U(m)) | (y & _U(k))) == 0
                near &= equal if i == len(group) - 1 else ~equal
        out[at : at + rows] = near.sum(axis=1)
    return out


def _near_counts(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, near) of the runs of rows in order of table and key that have any; a run that goes on in the next batch is carried over."""
    masks, held = _masks(radius), None

    def told(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        size = np.diff(np.concatenate((starts, [len(rows)])))
        near = np.zeros(len(rows), np.int64)
        for s, n in zip(starts[size > 1], size[size > 1]):
            near[s : s + n] = _run_counts(masks[int(rows[s, 0])], radius, rows[s : s + n, 2].view(np.uint64), rows[s : s + n, 3].view(np.uint64))
        found = near > 0
        return pa.RecordBatch.from_arrays([pa.array(rows[found, 2]), pa.array(rows[found, 3]), pa.array(near[found])], ["high", "low", "near"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if held is not None:
            rows = np.concatenate((held, rows))
        if not len(rows):
            continue
        last = len(rows) - int(np.argmax((rows[::-1, :2] != rows[-1, :2]).any(axis=1))) if (rows[:, :2] != rows[-1, :2]).any() else 0
        if last:
            yield told(rows[:last].copy(order="F"))
        held = rows[last:]
    if held is not None and len(held):
        yield told(held.copy(order="F"))


def near_counts(prints: DataFrame, radius: int = 3, long: int = LONG_BLOCK) -> DataFrame:
    """(fingerprint, n_near): how many other distinct fingerprints lie within the radius, of those that have any.

    All are found by the block tables, each pair by the first that can tell it; of a key's run only counts leave the task,
    never its pairs. Null fingerprints take no part, repeated ones count once. Radius 0 to 31.
    """
    rows = block_rows(prints.where("fingerprint is not null").select("fingerprint").distinct(), radius, long)
    ordered = rows.repartition("table", "key").sortWithinPartitions("table", "key")
    found = ordered.mapInArrow(functools.partial(_near_counts, radius), "high bigint, low bigint, near bigint")
    name = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("high", "low")]).alias("fingerprint")
    return found.groupBy("high", "low").agg(F.sum("near").alias("n_near")).select(name, "n_near")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, fingerprint) with the next document's text and fingerprint, in descending doc_id, in a ring.

    Null texts are empty; equal doc_ids go by text, a null doc_id comes last and goes by a hash of the text. Documents are
    dealt into ranges of that order; a range's last document takes the first of the next range, so that no task sees more
    than its range.
    """
    spark = docs.sparkSession
    parts = parts or 4 * shuffle_width(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("by_hash"))
    named = docs.where("doc_id is not null").select((-F.col("doc_id").cast("double")).alias("order"))
    cuts = named.agg(F.percentile_approx("order", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    deal = Bucketizer(splits=splits, inputCol="order", outputCol="bucket", handleInvalid="keep")
    rows = deal.transform(rows.withColumn("order", -F.col("doc_id").cast("double")))
    # Rows without an id: ranges of the hash behind those of ids, by its first bits.
    unnamed = F.lit(len(splits)) + (F.shiftright("by_hash", 57) + 64)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.col("bucket")).cast("int")).drop("order", "bucket")
    # Of each range the first document, by id or, where the range has none, by hash: at most `parts` + 128 rows, found without the texts.
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("d"), F.min("by_hash").alias("h")).withColumnRenamed("part", "p")
    firsts = rows.join(F.broadcast(heads), F.expr("part = p and doc_id <=> d and by_hash <=> h")).groupBy("part").agg(F.min("text").alias("after"))
    # The ring goes over the ranges' numbers alone; the texts follow by a join.
    ring, every = Window.orderBy("p"), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = heads.select("p", F.coalesce(F.lead("p").over(ring), F.first("p").over(every)).alias("next"))
    follow = ranges.join(firsts, F.col("next") == F.col("part")).select(F.col("p").alias("of"), "after")
    follow = follow.withColumn("after_fingerprint", fingerprint(F.col("after")))

    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("part").orderBy(F.desc("doc_id"), "by_hash", "text")
    rows = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    rows = rows.join(follow, F.col("part") == F.col("of"), "left")
    return rows.select(
        "doc_id", "text", "fingerprint",
        F.coalesce("next_text", "after").alias("next_text"), F.coalesce("next_fingerprint", "after_fingerprint").alias("next_fingerprint"),
    )


def edited_likeness(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and that of the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, in descending doc_id; the last document's next is the first, a lone document's is itself. Null texts are
    empty, texts of any length are read whole, repeated rows stay, other columns are ignored, an empty table gives an empty one. n_near is the number of other
    distinct fingerprints of the table within `radius` bits of the document's own, as the block tables find them.
    """
    small_batches(docs.sparkSession)
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    rows = cut(
        rows.select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )
    near = near_counts(rows, radius)
    copies = hot_keys(rows.groupBy("fingerprint").count(), "fingerprint", rows.count())
    found = dealt(rows, "fingerprint", copies).join(copied(near, "fingerprint", copies), ["fingerprint", "salt"], "left")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"))
