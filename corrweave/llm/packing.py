"""Best-fit packing by large-item matching.

Lengths are small integers, so the histogram of lengths (at most one row for each length up to the capacity) says all
that the packer needs: the plan of bins is made from counts, on the driver, and is exact for any number of pieces.
Pieces over a third of the capacity meet at most one other such piece in a bin, by greedy matching; smaller pieces go,
largest first, into the tightest remaining gap. Then each piece takes the place that its rank among the pieces of its
length gives it.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bpe
from .common import cut, shuffle_width, small_batches

PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Bins as (how many, lengths in it) for a histogram {length: count}; lengths are 1 to capacity."""
    left = {n: c for n, c in histogram.items() if c}
    bins: dict[int, list[list]] = defaultdict(list)  # by gap: [how many, lengths]

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= capacity - n and left[m] and (m < n or left[n] > 1)), None)
            if partner is None:
                bins[capacity - n].append([left[n], (n,)])
                left[n] = 0
            elif partner == n:
                pairs = left[n] // 2
                bins[capacity - 2 * n].append([pairs, (n, n)])
                left[n] -= 2 * pairs
            else:
                pairs = min(left[n], left[partner])
                bins[capacity - n - partner].append([pairs, (n, partner)])
                left[n] -= pairs
                left[partner] -= pairs

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[n]
        while need:
            gap = next((g for g in range(n, capacity) if bins.get(g)), capacity)
            many, held = bins[gap].pop() if gap < capacity else [-(-need // (capacity // n)), ()]
            each = min(gap // n, need)
            full = min(many, need // each)
            if many > full:  # the rest of these bins as they were; of new ones, as many as are needed
                rest = need - full * each
                if gap < capacity:
                    bins[gap].append([many - full, held])
                elif rest:
                    bins[gap - rest * n].append([1, held + (n,) * rest])
                    need -= rest
            if full:
                bins[gap - each * n].append([full, held + (n,) * each])
                need -= full * each
    return [(many, held) for group in bins.values() for many, held in group if many]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot, the bin that it falls in, the offset inside the bin."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for many, held in plan:
        offset = 0
        for n in held:
            rows[n].append((used[n], base, offset))
            used[n] += many
            offset += n
        base += many
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in rows.items()}


def _pieces(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = bpe.load(path).ids
    tail = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = (encode(text.as_py()).astype("<u4").tobytes() if text.is_valid else b"") + tail
            n = len(ids) // 4
            begin, end = 0, n % capacity or capacity
            piece = 0
            while begin < n:
                row = (doc_id, piece, begin, end - begin, zlib.crc32(memoryview(ids)[4 * begin : 4 * end]))
                for column, x in zip(out, row):
                    column.append(x)
                begin, end, piece = end, end + capacity, piece + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of at most `capacity` tokens of each document's ids and the end id; only the first may be shorter."""
    run = functools.partial(_pieces, tokenizer_path or bpe.default_path(), capacity, end_id)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES_SCHEMA)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A null or empty text has the end id alone, texts of any length are cut into as many pieces as they fill. Repeated rows are packed as often as they occur, ties in length are
    broken by doc_id, piece, start and content, other columns are ignored, an empty table gives an empty one. The driver holds the
    histogram of lengths, at most `capacity` rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = cut(cut_pieces(docs, capacity, end_id, tokenizer_path))
    # One length may be hot (copies of one document), so ranks are taken in salted parts and shifted by the parts before.
    salts = 4 * shuffle_width(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(7)), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan_bins(histogram, capacity))

    @arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, at = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size):
            mine = np.flatnonzero(size == n)
            first, base, off = places[int(n)]
            k = np.searchsorted(first, at[mine], side="right") - 1
            sequence[mine] = base[k] + at[mine] - first[k]
            offset[mine] = off[k]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(parts, ["length", "salt"])
    ranked = ranked.withColumn("place", place("length", F.col("before") + F.col("within") - 1))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
