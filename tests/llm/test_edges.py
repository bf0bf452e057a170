"""Every operator over an awkward table and an empty one: a row for each row, nothing crashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrweave.llm import fingerprints, language, near_dedup, packing, pieces, pii, quality, search, token_counts, wrappers


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 1), (None, 1, 0), (6, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.edited_likeness(d), "language": lambda s, d: language.identify(d), "pieces": lambda s, d: pieces.encoded_digests(d),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d), "quality": lambda s, d: quality.classify(d, labels(s)), "token_counts": lambda s, d: token_counts.count_tokens(d),
    "pii": lambda s, d: pii.personal_data(d), "wrappers": lambda s, d: wrappers.main_text(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "score")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay(spark, nasty, name):
    rows = OPERATORS[name](spark, nasty).collect()
    assert len(rows) == nasty.count()
    assert OPERATORS[name](spark, nasty.limit(0)).count() == 0


def test_packing_edges(spark, nasty):
    assert packing.pack(nasty).where("piece = 0").count() == nasty.count()
    assert packing.pack(nasty.limit(0)).count() == 0


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [float("nan"), 1.0]), (1, [1.0, None]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 1.0]), (4, [5.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in search.top_k(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3)]
    assert search.top_k(df.limit(0)).count() == 0


def test_search_of_large_components(spark):
    """Products beyond 2^53 stay exact, scores beyond a long are the nearest long and tie to the smaller vec_id."""
    rows = [(0, [3e9, 1.0]), (1, [3e9, -2.0]), (2, [3e9, 5.0]), (3, [-1e300, 0.0]), (4, [1e300, 0.0]), (5, [2e15, 0.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = search.top_k(df).orderBy("rank").collect()
    top, low = (1 << 63) - 1, -(1 << 63)
    v = {i: [max(low, min(top, int(np.floor(1024 * x)))) for x in e] for i, e in rows}
    want = sorted((-max(low, min(top, sum(a * b for a, b in zip(v[0], v[i])))), i) for i in v if i)
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]
    few = search.top_k(df, k=2, block=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(i, -s) for s, i in want[:2]]


def test_search_prunes_and_stays_exact():
    """Clusters far apart: far fewer pairs are scored than there are, and nothing is lost."""
    r = np.random.default_rng(4)
    points = np.concatenate([r.integers(-20, 20, (400, 4)) + c for c in ([9000, 0, 0, 0], [0, 9000, 0, 0], [-9000, 0, 0, 0], [0, 0, 9000, 0])]).astype(float)
    queries = points[::50]
    scored = []
    best = search.dual_tree_top_k(np.arange(0, 1600, 50), queries, np.arange(1600), points, 10)
    plain = search._Best.offer
    try:
        search._Best.offer = lambda self, rows, scores, ids: scored.append(scores.size) or plain(self, rows, scores, ids)
        search.dual_tree_top_k(np.arange(0, 1600, 50), queries, np.arange(1600), points, 10)
    finally:
        search._Best.offer = plain
    for n, q in enumerate(range(0, 1600, 50)):
        want = sorted((-float(queries[n] @ points[i]), i) for i in range(1600) if i != q)[:10]
        assert [(-s, i) for s, i in zip(best.score[n], best.match[n])] == want
    assert sum(scored) < 0.5 * len(queries) * len(points)


def test_ring_of_the_smallest_and_largest_ids(spark):
    """The smallest long has no negative; ids beyond a double's whole numbers keep their order."""
    ids = [-(1 << 63), -(1 << 63) + 1, -1, 0, 7, (1 << 63) - 2, (1 << 63) - 1]
    df = spark.createDataFrame([(i, f"text {n} of several words") for n, i in enumerate(ids)], "doc_id bigint, text string")
    for parts in (1, 3, 16):
        after = {r.doc_id: r.next_text for r in fingerprints.with_next(df, parts).collect()}
        assert after == {i: f"text {(n - 1) % len(ids)} of several words" for n, i in enumerate(ids)}
