"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints within 3 bits, cut into two segments, differ by at most one bit in one of them. Each fingerprint is
indexed under every segment with one bit wildcarded; an equality of such variants makes a candidate, which is verified
on the whole fingerprints. Work is done on distinct fingerprints, and a large bucket tells a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bits import bit_counts, pack_bits
from .common import chunks, copied, cut, dealt, hot_keys, small_batches, stored
from .components import components

RADIUS = 3
#: Runs of up to so many fingerprints under one variant are compared by shifted arrays, longer ones by search.
SHORT_RUN = 32


def _text_hashes(text: bytes, k: int, seed: int, hash_=xxhash.xxh64_intdigest) -> list[int]:
    words = text.lower().split()  # on bytes: A-Z alone, and white space is 0x20 and 0x09 to 0x0D
    if len(words) <= k:
        return [hash_(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -k].tolist()]
    return [hash_(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprint_array(texts: pa.Array, k: int = 3, seed: int = 42) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for part in chunks(texts):
        hashes = [_text_hashes(t or b"", k, seed) for t in part.cast(pa.binary()).to_pylist()]
        n = np.array([len(h) for h in hashes], dtype=np.int64)
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
        out.append(pack_bits(2 * bit_counts(flat[:, None], n) > n[:, None])[:, 0])
    return np.concatenate(out)


def fingerprint(text: Column, k: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash, as a signed bigint: a bit is set where over half the shingles' XXH64 have it. No word: 0."""

    @arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_array(texts, k, seed).view(np.int64))

    return simhash(text)


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of the two 32-bit segments; a key names segment and wildcard bit too."""

    def key(bit: Column) -> Column:
        low, one = F.lit(0xFFFFFFFF), F.lit(1).cast("bigint")
        segment = F.when(bit < 32, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
        wildcard = F.bitwise_not(F.call_function("shiftleft", one, F.pmod(bit, F.lit(32))))
        return F.call_function("shiftleft", bit.cast("bigint"), F.lit(32)) + segment.bitwiseAND(wildcard)

    bits = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return bits.select(key(F.col("bit")).alias("key"), "fp")


#: A segment that more fingerprints share is long: the runs of its variants are split by the other segment's bytes.
LONG_SEGMENT = 4096


def split_runs(keyed: DataFrame, prints: DataFrame, long: int = LONG_SEGMENT) -> DataFrame:
    """`keyed` (key, fp) with the keys of long runs split into up to 1,024 each, so that no run has to be held by one task.

    Two fingerprints of a run differ in at most 3 bits of the other segment, so one of its 4 bytes is equal: each row of a
    long run is told under all 4 bytes, each a key of its own. A run can be long only if one of the two segments that it
    joins is; those are found by counting 2 rows a fingerprint, and are at most 2 / `long` of the fingerprints. Rows of
    other runs stay as they are.
    """
    low = F.lit(0xFFFFFFFF)
    segments = prints.select(F.posexplode(F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32))).alias("side", "segment"))
    many = segments.groupBy("side", "segment").count().where(F.col("count") > long)
    bit = F.col("side") * 32 + F.col("place")
    wildcard = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place")))
    key = F.call_function("shiftleft", bit.cast("bigint"), F.lit(32)) + F.col("segment").bitwiseAND(wildcard)
    split = many.select("side", "segment", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place")).select(key.alias("long_key")).distinct()
    split = stored(split, "long-keys")  # as a table of known size, so that the rows are not shuffled to join a few keys
    other = F.when(F.shiftright("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(low))
    # Bits 40 up of a key: 1 + 256 * (place of the byte) + byte.
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lit(1).cast("bigint") + i * 256 + F.call_function("pmod", F.call_function("shiftrightunsigned", other, i * 8), F.lit(256)))
    parts = F.when(F.col("long_key").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(bytes_)
    rows = keyed.join(split, F.col("key") == F.col("long_key"), "left").select("key", "fp", F.explode(parts).alias("part"))
    return rows.select((F.col("key") + F.call_function("shiftleft", F.col("part"), F.lit(40))).alias("key"), "fp")


def _told_here(bit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of the variants that a pair with difference x shares, the first tells it."""
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    n_low, n_high = np.bitwise_count(low), np.bitwise_count(high)
    one = np.bitwise_count(low - (n_low == 1)).astype(np.int64)  # the place of a single bit
    other = np.bitwise_count(high - (n_high == 1)).astype(np.int64)
    first = np.where(n_low == 0, 0, np.where(n_low == 1, one, np.where(n_high == 0, 32, 32 + other)))
    return (n_low + n_high <= RADIUS) & (first == bit)


def _search_run(bit: int, fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of one run's links: each found member is compared with those not yet found alone."""
    a, b = [], []
    left = fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _told_here(np.int64(bit), left ^ at)
            found = left[hit]
            left = left[~hit]
            front += list(found)
            a += [int(at)] * len(found)
            b += found.tolist()
    return a, b


def _runs(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bit = (key >> 32).astype(np.int64) & 63
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    short = np.repeat(size <= SHORT_RUN, size)
    for step in range(1, int(min(size.max(), SHORT_RUN))):
        i = np.flatnonzero(short[:-step] & (key[:-step] == key[step:]))
        i = i[_told_here(bit[i], fps[i] ^ fps[i + step])]
        a.append(fps[i])
        b.append(fps[i + step])
    for s, n in zip(first[size > SHORT_RUN], size[size > SHORT_RUN]):
        u, v = _search_run(int(bit[s]), fps[s : s + n])
        a.append(np.array(u, np.uint64))
        b.append(np.array(v, np.uint64))
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, fp) rows; a key's run that goes on in the next batch is carried over."""

    def told(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _runs(key, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held_key, held_fp = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield told(np.concatenate((*held_key, key[:last])), np.concatenate((*held_fp, fps[:last])))
            held_key, held_fp = [], []
        elif len(held_key[-1]) and held_key[-1][-1] != key[0]:
            yield told(np.concatenate(held_key), np.concatenate(held_fp))
            held_key, held_fp = [], []
        held_key.append(key[last:].copy())
        held_fp.append(fps[last:].copy())
    if sum(map(len, held_key)):
        yield told(np.concatenate(held_key), np.concatenate(held_fp))


def fingerprint_links(prints: DataFrame, long: int = LONG_SEGMENT) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` that differ in 1 to 3 bits: enough of them to connect what all would connect."""
    prints = prints.select("fp").distinct()
    return split_runs(variants(prints), prints, long).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    Texts without words, null ones included, have fingerprint zero and link like any other; of texts of any length all
    shingles vote. component_id is the
    smallest doc_id reachable over links of 3 or fewer differing bits. Repeated rows stay and share a component, a
    null doc_id is never a component's id unless it has no other, other columns are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select("doc_id", fingerprint(F.col("text"), k, seed).alias("fp")))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("count")))
    named = named_components(first)
    # The component's own name is a fingerprint; its smallest doc_id is what is wanted.
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("count"))
    large = hot_keys(least, "component", named.count())
    of_print = dealt(named, "component", large).join(copied(least, "component", large), ["component", "salt"]).select("fp", "component_id")
    copies = hot_keys(first, "fp", prints.count())
    rows = dealt(prints, "fp", copies).join(copied(of_print, "fp", copies), ["fp", "salt"])
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def named_components(first: DataFrame) -> DataFrame:
    """`first` (fp, ..), a row for each distinct fingerprint, with `component`, a fingerprint that names its component."""
    groups = components(fingerprint_links(first))
    named = first.join(groups, first.fp == groups.node, "left").withColumn("component", F.coalesce("component", "fp"))
    return cut(named.select(*first.columns, "component"))


def deduplicated(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate component of `docs` (doc_id, text, ..), with all its columns.

    The row with the smallest doc_id stays; without one only where the component has no other. Of several rows with that
    doc_id the one with the smallest hash of all its values stays, so a text never goes for a namesake of another
    component, and of rows that are equal in every column one. Null and empty texts are one component. Columns of any
    name may be there; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    # 96 bits of all values name a row; both are keys of the join and of what follows, so that texts are shuffled once.
    values = [F.col(f"`{c}`") for c in docs.columns]
    hashes = {_unused(docs, "hash"): F.xxhash64(*values), _unused(docs, "more"): F.hash(*values)}
    names = list(hashes)
    rows = cut(docs.select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *[h.alias(n) for n, h in hashes.items()], fingerprint(F.col("text"), k, seed).alias("fp")))
    first = cut(rows.groupBy("fp").agg(F.min(F.struct("unnamed", "doc_id", *names)).alias("first")))
    kept = named_components(first).groupBy("component").agg(F.min("first").alias("first"))
    return docs.withColumns(hashes).join(kept.select(*[F.col(f"first.{n}").alias(n) for n in names]), names, "left_semi").dropDuplicates(names).drop(*names)


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
