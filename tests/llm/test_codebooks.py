"""Yinyang Lloyd against plain Lloyd over Python's integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corrweave.llm import codebooks

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain_codes(rows, parts=4, k=256, rounds=4):
    """Every distance to every entry, in whole numbers."""
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x) if abs(x) < 1e300 else int(math.copysign(1 << 64, x))))
    kept = sorted(((i is None, i, [hold(x) for x in e], l) for i, e, l in rows if e and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0], r[1] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [c[:k] for c in cut]

    def nearest(p):
        return [min((sum((x - y) ** 2 for x, y in zip(v, e)), j) for j, e in enumerate(books[p])) for v in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v, (_, j) in zip(cut[p], nearest(p)):
                groups[j].append(v)
            for j, members in groups.items():
                books[p][j] = [sum(c) // len(members) for c in zip(*members)]
    last = [nearest(p) for p in range(parts)]
    error = [min(sum(last[p][i][0] for p in range(parts)), (1 << 63) - 1) for i in range(len(kept))]
    by_label = defaultdict(int)
    for r, e in zip(kept, error):
        by_label[r[3]] += e
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[1], "".join(f"{last[p][i][1]:02x}" for p in range(parts)), error[i], min(by_label[r[3]], (1 << 63) - 1), said) for i, r in enumerate(kept)), key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in codebooks.compressed(df, **how).collect()), key=repr)


def test_codes_of_clusters_with_ties(spark):
    """Few distinct whole vectors, so that most distances tie; a hot label and null labels."""
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) / 1024 for x in r.integers(-3, 4, 8)], None if i % 5 == 0 else 1 if i % 3 else int(i % 7)) for i in r.permutation(600)]
    assert found(spark.createDataFrame(rows, SCHEMA), k=32) == plain_codes(rows, k=32)


def test_codes_of_awkward_rows(spark):
    """Nulls, non-finite and empty vectors, other lengths, repeated rows, components beyond a long, clashing columns; an empty table."""
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.5, -0.0001, 0.25, 9.0], None), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 2)]
    rows += [(6, [float("inf"), 1.0, 1.0, 1.0], 2), (7, [], 3), (None, [7.0, 7.0, 7.0, 7.0], None), (8, [1e10, -1e12, 3e9, 1.0], 2), (9, [1e300, -1e300, 1e18, 2.0], 2), (10, [-1e15, 1e15, 0.0, 0.0], 3)]
    df = spark.createDataFrame([*rows, (11, [1.0], 1)], SCHEMA).withColumns({"v": F.lit("v"), "entry": F.lit(1), "same": F.lit(None), "code": F.lit("c")})
    for k in (2, 256):
        assert found(df, k=k) == plain_codes(rows, k=k)
    assert codebooks.compressed(df.limit(0)).count() == 0
    assert codebooks.compressed(df.where("vec_id = 2")).count() == 0


def test_length_that_parts_do_not_divide(spark):
    rows = [(i, [float((i * 7 + j) % 11) for j in range(6)], 0) for i in range(40)]
    padded = [(i, [*e, 0.0, 0.0], l) for i, e, l in rows]
    assert found(spark.createDataFrame(rows, SCHEMA), k=8) == plain_codes(padded, k=8)


def test_bounds_skip_groups_and_lose_nothing():
    """Over clusters, far fewer distances are taken than there are, and each assignment is the plain one."""
    r = np.random.default_rng(8)
    centres = r.integers(-20_000, 20_000, (64, 8))
    x = (centres[r.integers(0, 64, 3000)] + r.integers(-300, 300, (3000, 8))).astype(np.int64)
    entries = x[:64].copy()
    groups = codebooks.grouped(entries)
    entry, upper, lower = codebooks.first_assignment(x, entries, groups)
    taken = 0
    for _ in range(6):
        moved = entries.copy()
        for j in np.unique(entry):
            moved[j] = x[entry == j].sum(0) // (entry == j).sum()
        drift = np.sqrt(((moved - entries) ** 2).sum(1)) * (1 + codebooks.SLACK)
        entries = moved
        entry, upper, lower, n = codebooks.next_assignment(x, entries, groups, drift, entry, upper, lower)
        taken += n
        d2 = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (entry == d2.argmin(1)).all()
        assert (upper >= np.sqrt(d2[np.arange(3000), entry])).all()
        d2[np.arange(3000), entry] = np.iinfo(np.int64).max
        assert all((lower[:, g] <= np.sqrt(d2[:, m].min(1))).all() for g, m in enumerate(groups))
    assert taken < 0.35 * 6 * x.shape[0] * 64


def test_sums_of_large_numbers_are_handed_on(spark):
    """Sums beyond a long: each row by itself, added up as decimals."""
    rows = [(i, [9e15, -9e15, 8.5e15, float(i)], 0) for i in range(20)]
    assert found(spark.createDataFrame(rows, SCHEMA), k=3) == plain_codes(rows, k=3)
