"""Vector codes by product quantization, with codebooks from Yinyang Lloyd over whole numbers.

Each part of a vector keeps an upper bound of its distance to its entry and, for each group of entries, a lower bound of
its distance to all others of the group. When entries move, bounds move by the drift of the entry or of the group; only
groups whose lower bound no longer clears the upper one are scanned. Distances that are compared are whole numbers, so ties
go to the lower index whatever the rounding of bounds. Vectors, assignments and bounds lie in a table that each round
rewrites; the driver holds codebooks, whose sums come from one aggregate of at most a row for each entry and task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copied, dealt, hot_keys, small_batches, stored

#: Entries of a codebook for each group of them.
GROUP = 10
#: Room for the rounding of bounds, as a share of them.
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1

Groups = list[np.ndarray]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (n, k) between whole numbers, exact: doubles where all of it stays under 2^53, else Python's integers."""
    reach = float(np.abs(x.astype(np.float64)).max(initial=0)) + float(np.abs(entries.astype(np.float64)).max(initial=0))
    if x.shape[1] * reach * reach < 2.0**52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
    a, b = x.astype(object), entries.astype(object)
    return np.array([[sum((p - q) ** 2 for p, q in zip(u, v)) for v in b] for u in a], dtype=object).reshape(len(a), len(b))


def _own(x: np.ndarray, entries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own entry, exact as in `squared`."""
    reach = float(np.abs(x.astype(np.float64)).max(initial=0)) + float(np.abs(entries.astype(np.float64)).max(initial=0))
    kind = np.float64 if x.shape[1] * reach * reach < 2.0**52 else object
    d = x.astype(kind) - entries.astype(kind)[entry]
    return (d * d).sum(1)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def grouped(entries: np.ndarray, rounds: int = 5) -> Groups:
    """The entries' numbers in groups of near ones. Any grouping gives the same codes; near ones give tighter bounds."""
    k = len(entries)
    points, n = entries.astype(np.float64), max(1, -(-k // GROUP))
    centres = points[np.linspace(0, k - 1, n).astype(int)]
    for _ in range(rounds):
        near = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([points[near == g].mean(0) if (near == g).any() else centres[g] for g in range(n)])
    return [m for g in range(n) if len(m := np.flatnonzero(near == g))]


def _least(d2: np.ndarray, groups: Groups, entry: np.ndarray) -> np.ndarray:
    """Distance to the nearest of each group but the row's own entry, rounded down; infinite where none is known."""
    d = _root(d2)
    d[np.arange(len(d)), entry] = np.inf
    return np.stack([d[:, g].min(1) for g in groups], axis=1) * (1 - SLACK)


def first_assignment(x: np.ndarray, entries: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower index), its upper bound and the groups' lower bounds."""
    d2 = squared(x, entries)
    entry = d2.argmin(1)
    return entry, _root(d2[np.arange(len(x)), entry]) * (1 + SLACK), _least(d2, groups, entry)


def next_assignment(x: np.ndarray, entries: np.ndarray, groups: Groups, drift: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved by `drift`, from the bounds before; and how many distances were taken."""
    upper = (upper + drift[entry]) * (1 + SLACK)
    lower = (lower - np.array([drift[g].max() for g in groups])) * (1 - SLACK) - SLACK
    open_ = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(open_):
        return entry, upper, lower, 0
    mine, own = x[open_], entry[open_]
    d2 = _own(mine, entries, own)
    upper[open_] = _root(d2) * (1 + SLACK)
    scan = lower[open_] <= upper[open_][:, None]
    known = np.full((len(open_), len(entries)), np.inf, dtype=d2.dtype)
    known[np.arange(len(open_)), own] = d2
    taken = len(open_)
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if len(rows):
            found = squared(mine[rows], entries[members])
            if found.dtype != known.dtype:
                known = known.astype(object)
            known[np.ix_(rows, members)] = found
            taken += found.size
    best = known.argmin(1)
    near = _least(known, groups, best)
    entry, lower = entry.copy(), lower.copy()
    entry[open_] = best
    upper[open_] = _root(known[np.arange(len(open_)), best]) * (1 + SLACK)
    lower[open_] = np.where(scan, near, np.minimum(lower[open_], near))
    return entry, upper, lower, taken


def _matrix(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(n, -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, w = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(matrix.ravel()))


@dataclass(frozen=True)
class Codebooks:
    """For each part (k, width) entries and their groups."""

    entries: tuple[np.ndarray, ...]
    groups: tuple[Groups, ...]

    def drift(self, before: Codebooks) -> list[np.ndarray]:
        return [_root(_own(a, b, np.arange(len(a)))) * (1 + SLACK) for a, b in zip(self.entries, before.entries)]

    def sha256(self) -> str:
        said = ",".join(str(int(x)) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(said.encode()).hexdigest()


def _assign(books: Codebooks, drifts: list[np.ndarray] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = books.entries[0].shape[1]
    sizes = np.cumsum([0] + [len(g) for g in books.groups])
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column("v"), np.int64)
        parts = [v[:, p * width : (p + 1) * width] for p in range(len(books.entries))]
        if drifts is None:
            found = [first_assignment(x, e, g) for x, e, g in zip(parts, books.entries, books.groups)]
        else:
            entry, upper, lower = _matrix(batch.column("entry"), np.int64), _matrix(batch.column("upper"), np.float64), _matrix(batch.column("lower"), np.float64)
            found = [next_assignment(x, e, g, drifts[p], entry[:, p], upper[:, p], lower[:, sizes[p] : sizes[p + 1]])[:3] for p, (x, e, g) in enumerate(zip(parts, books.entries, books.groups))]
        low = np.concatenate([f[2] for f in found], axis=1)
        low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
        new = [_lists(np.stack([f[0] for f in found], axis=1).astype(np.int32)), _lists(np.stack([f[1] for f in found], axis=1)), _lists(low)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), *new], ["vec_id", "label", "v", "entry", "upper", "lower"])


def _sums(n_parts: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n, sums): of each part's entries in use, counts and componentwise sums of what this task holds."""

    def told(slot: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n), _lists(sums)], ["slot", "n", "sums"])

    n = sums = None
    reach = 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        v, entry = _matrix(batch.column("v"), np.int64), _matrix(batch.column("entry"), np.int64)
        slot, x = (entry + np.arange(n_parts) * k).ravel(), v.reshape(len(v) * n_parts, -1)
        if sums is None:
            n, sums = np.zeros(n_parts * k, np.int64), np.zeros((n_parts * k, x.shape[1]), np.int64)
        here = float(np.abs(v.astype(np.float64)).max()) * len(v)
        if here >= 2.0**61:  # numbers too large to add up here
            yield told(slot, np.ones(len(slot), np.int64), x)
            continue
        if reach + here >= 2.0**62:
            used = np.flatnonzero(n)
            yield told(used, n[used], sums[used])
            n[:], sums[:], reach = 0, 0, 0.0
        reach += here
        n += np.bincount(slot, minlength=len(n))
        np.add.at(sums, slot, x)
    if n is not None and n.any():
        used = np.flatnonzero(n)
        yield told(used, n[used], sums[used])


def moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the componentwise floor of the mean of its parts; unused entries stay."""
    k, width = books.entries[0].shape
    partial = state.select("v", "entry").mapInArrow(functools.partial(_sums, len(books.entries), k), "slot int, n bigint, sums array<bigint>")
    columns = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    entries = [e.copy() for e in books.entries]
    for r in partial.groupBy("slot").agg(F.sum("n").alias("n"), *columns).collect():  # a row for each entry of each part at most
        part, entry = divmod(r["slot"], k)
        entries[part][entry] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(tuple(entries), books.groups)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): components x as floor(1024 * x), held to a long; without vectors that are null, empty or hold null or non-finite components."""
    x = F.col("embedding")
    good = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))
    rows = vectors.where(x.isNotNull()).where(good)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform(x, lambda e: F.floor(1024 * e.cast("double")).cast("bigint")).alias("v"))


def trained(vectors: DataFrame, parts: int = 4, k: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, v, entry, upper, lower) in the last codebooks' terms, and these; None where no vector is kept.

    Vectors of another length than that of the smallest kept vec_id's take no part; where `parts` doesn't divide the
    length, zeros fill the last part. Equal vec_ids go by their vectors, null ones come last.
    """
    small_batches(vectors.sparkSession)
    kept = whole_vectors(vectors)
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = kept.orderBy(*order).first()
    if first is None:
        return kept, None
    length = len(first["v"])
    width = -(-length // parts)
    kept = kept.where(F.size("v") == length)
    if width * parts > length:
        kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), width * parts - length)))
    start = np.array([r["v"] for r in kept.orderBy(*order).limit(k).collect()], dtype=np.int64)
    entries = tuple(start[:, p * width : (p + 1) * width].copy() for p in range(parts))
    books, drifts, state = Codebooks(entries, tuple(map(grouped, entries))), None, kept
    kinds = f"vec_id bigint, label {dict(vectors.dtypes)['label']}, v array<bigint>, entry array<int>, upper array<double>, lower array<float>"
    for _ in range(rounds):
        state = stored(state.mapInArrow(functools.partial(_assign, books, drifts), kinds), "codes")
        before, books = books, moved(state, books)
        drifts = books.drift(before)
    return stored(state.mapInArrow(functools.partial(_assign, books, drifts), kinds), "codes"), books


def _coded(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = books.entries[0].shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        v, entry = _matrix(batch.column("v"), np.int64), _matrix(batch.column("entry"), np.int64)
        error = sum(_own(v[:, p * width : (p + 1) * width], e, entry[:, p]).astype(object) for p, e in enumerate(books.entries))
        codes = ["".join(f"{i:02x}" for i in row) for row in entry.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])


def compressed(vectors: DataFrame, parts: int = 4, k: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept vector of `vectors` (vec_id, embedding, label).

    code: the 0-based entries in part order, two hex digits each. error: squared distances to them, summed over parts.
    label_error: error summed over equal labels, nulls together. Vectors that are null, empty or hold null or non-finite
    components are left out, as are those of another length than the first's. Repeated rows stay, ties go to the lower
    index, fewer than `k` vectors make smaller codebooks, numbers beyond a long are the nearest long, other columns are
    ignored, an empty table gives an empty one.
    """
    if k > 256:
        raise ValueError("two hex digits hold 256 entries")
    state, books = trained(vectors.select("vec_id", "embedding", "label"), parts, k, rounds)
    if books is None:
        none = F.lit(None)
        return state.select("vec_id", none.cast("string").alias("code"), none.cast("bigint").alias("error"), none.cast("bigint").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    coded = state.select("vec_id", "label", "v", "entry").mapInArrow(functools.partial(_coded, books), f"vec_id bigint, label {dict(state.dtypes)['label']}, code string, error bigint")
    coded = stored(coded.withColumn("same", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "coded")
    sums = coded.groupBy("same").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("count"))
    label_error = F.least("sum", F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    sums = stored(sums.select("same", label_error.alias("label_error"), "count"), "labels")
    hot = hot_keys(sums, "same", coded.count())
    rows = dealt(coded, "same", hot).join(copied(sums.drop("count"), "same", hot), ["same", "salt"])
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
