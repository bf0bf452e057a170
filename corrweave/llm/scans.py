"""Prefix sums over a whole order: partitions of a sort are scanned side by side, each from what all before it carry on."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted as a whole and cut, with `part`, the number of each row's partition: all of part i comes before part i + 1.

    Ranges are of the whole order, so that one hot value of its first column lies in several parts.
    """
    rows = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut(rows.withColumn("part", F.spark_partition_id()))


def _segments(key: pa.Array | None, n: int, last: pa.Scalar | None) -> tuple[np.ndarray, bool]:
    """Where in a batch rows of a new key begin (0 at least, even if it goes on), and whether its first row goes on with the last key."""
    if key is None:
        return np.zeros(1, np.int64), last is not None
    key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
    turns = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
    return np.concatenate(([0], turns)), last is not None and key[0] == last


def _scan(values: list[np.ndarray], starts: np.ndarray, carried: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of all rows before in the same segment, modulo 2^64, the first segment from `carried`; what the last one carries on."""
    n = len(values[0])
    segment = np.zeros(n, np.int64)
    segment[starts[1:]] = 1
    segment = np.cumsum(segment)
    before, on = [], np.zeros(len(values), np.uint64)
    for i, x in enumerate(values):
        total = np.cumsum(x, dtype=np.uint64)
        base = np.concatenate(([np.uint64(0)], total[starts[1:] - 1]))
        base[:1] -= carried[i : i + 1]  # arrays wrap around without a warning
        sums = total - base[segment]
        before.append(sums - x)
        on[i] = sums[-1]
    return before, on


def _unsigned(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    """A one for each row, then the columns; longs as 64 bits."""
    longs = [batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
    return [np.ones(batch.num_rows, np.uint64), *longs]


def _tails(key: str | None, columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: its rows, whether they are of one key, the first and the last key, the sums over the last key's rows."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        part, keys = batch.column("part")[0].as_py(), batch.column(key) if key else None
        mine = held.setdefault(part, [0, True, None, None, np.zeros(len(columns) + 1, np.uint64)])
        starts, on = _segments(keys, batch.num_rows, mine[3])
        mine[1] &= len(starts) == 1 and (on or mine[0] == 0)
        _, mine[4] = _scan(_unsigned(batch, columns), starts, mine[4] if on else np.zeros(len(columns) + 1, np.uint64))
        if mine[2] is None:
            mine[2] = keys[0] if key else pa.scalar(True)
        mine[3] = keys[-1] if key else pa.scalar(True)
        mine[0] += batch.num_rows
    rows = [(p, n, one, str(first), str(last), tail.view(np.int64).tolist()) for p, (n, one, first, last, tail) in held.items()]
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "n", "one", "first", "last", "tail"])


def _carries(parts: list) -> dict[int, tuple[int, str | None, list[int]]]:
    """What each part goes on from: the rows before it, the last key before it and the sums over that key's rows so far."""
    out, rows, last, sums = {}, 0, None, None
    for p in sorted(parts, key=lambda r: r["part"]):
        out[p["part"]] = (rows, last, sums)
        goes_on = p["one"] and last is not None and p["first"] == last
        sums = [(a + b) % (1 << 64) for a, b in zip(sums, p["tail"])] if goes_on else [x % (1 << 64) for x in p["tail"]]
        rows, last = rows + p["n"], p["last"]
    return out


def _running(key: str | None, columns: list[str], carries: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, sums, at = None, None, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key) if key else None
        if batch.column("part")[0].as_py() != part:
            part = batch.column("part")[0].as_py()
            at, said, sums = carries[part]
            first = str(keys[0]) if key else "True"
            last = (keys[0] if key else pa.scalar(True)) if said == first else None
        starts, on = _segments(keys, n, last)
        values = _unsigned(batch, columns)
        before, sums = _scan(values, starts, np.array(sums, np.uint64) if on else np.zeros(len(values), np.uint64))
        last = keys[-1] if key else pa.scalar(True)
        new = [np.arange(at, at + n), *(x.view(np.int64) for x in before), *((b + v).view(np.int64) for b, v in zip(before[1:], values[1:]))]
        at += n
        names = ["at", "within", *(f"before_{c}" for c in columns), *(f"upto_{c}" for c in columns)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*batch.schema.names, *names])


def running(rows: DataFrame, key: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `in_order`, with their places and prefix sums.

    at: the place in the whole order, from 0. within: the place among the rows of one `key` (not null, equal keys stand
    together), or `at` without one. before_x and upto_x for each of `sums` (longs, not null, modulo 2^64): the sum over
    the key's rows before this one, and with it. The driver sees one row a partition, with keys as text.
    """
    columns = list(sums)
    summary = rows.select("part", *([key] if key else []), *columns).mapInArrow(functools.partial(_tails, key, columns), "part int, n bigint, one boolean, first string, last string, tail array<bigint>")
    carries = _carries(summary.collect())
    new = ["at", "within", *(f"before_{c}" for c in columns), *(f"upto_{c}" for c in columns)]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"{c} bigint" for c in new])
    return rows.mapInArrow(functools.partial(_running, key, columns, carries), schema)
