"""Hot join keys: dealt over salts, nothing lost or doubled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrweave.llm import components as components_module
from corrweave.llm import near_dedup
from corrweave.llm.common import HOT_SHARE, copied, cut, dealt, hot_keys, stored
from corrweave.llm.components import components


def test_dealt_join_is_the_plain_join(spark):
    rows = cut(spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2500).alias("key")))
    lookup = rows.select("key").distinct().where("key <> 7").withColumn("said", F.col("key") * 2)
    hot = hot_keys(rows.groupBy("key").count(), "key", 9000)
    assert hot.count() < HOT_SHARE and {r.hot_key for r in hot.collect()} == {-1}
    given = dealt(rows, "key", hot)
    assert given.where("key = -1").select("salt").distinct().count() > 1
    assert given.where("key <> -1 and salt <> 0").count() == 0
    got = given.join(copied(lookup, "key", hot), ["key", "salt"]).select("id", "said")
    assert sorted(got.collect()) == sorted(rows.join(lookup, "key").select("id", "said").collect())


def test_no_rows_have_no_hot_keys(spark):
    none = spark.createDataFrame([], "key bigint, count bigint")
    assert hot_keys(none, "key", 0).count() == 0


def test_hubs_and_chains(spark):
    star = [(5, i) for i in range(1000, 3000)]
    chain = [(i, i + 1) for i in range(100, 160)]
    links = spark.createDataFrame(star + chain + [(7, 7), (9, 8), (8, 9), (3, None)], "a bigint, b bigint")
    want = {5: 5, 8: 8, 9: 8} | {i: 5 for i in range(1000, 3000)} | {i: 100 for i in range(100, 161)}
    assert {r.node: r.component for r in components(links).collect()} == want
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("middle", ["up", "down", "mixed"])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, middle):
    """A chain of 2,000 nodes whose two ends hold the smallest names: a walk along it would take 1,000 rounds."""
    names = list(range(2, 2000))
    names = names[::-1] if middle == "down" else [(x * 1237) % 1998 + 2 for x in range(1998)] if middle == "mixed" else names
    path = [0, *names, 1]
    assert len(set(path)) == 2000
    cuts = []
    monkeypatch.setattr(components_module, "stored", lambda df, kind: cuts.append(1) or stored(df, kind))
    got = components(spark.createDataFrame(list(zip(path, path[1:])), "a bigint, b bigint")).collect()
    assert {r.component for r in got} == {0} and len(got) == 2000
    assert (len(cuts) - 2) / 2 <= 16


def test_split_runs_tell_the_same_links(spark):
    """Fingerprints of one segment, some of them near each other: the same components whether their run is split or not."""
    r = np.random.default_rng(3)
    base = int(r.integers(1 << 31))
    high = r.integers(0, 1 << 31, 300)
    fps = {(int(h) << 32) | base for h in high} | {((int(h) ^ (1 << int(b)) ^ (1 << int(c))) << 32) | (base ^ 1) for h in high[:60] for b, c in [r.choice(31, 2, replace=False)]}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for long in (10, 10_000):
        links = {frozenset((x.a, x.b)) for x in near_dedup.fingerprint_links(df, long).collect()}
        assert links <= want and {frozenset(c) for c in by_component(links)} == {frozenset(c) for c in by_component(want)}
    split = near_dedup.split_runs(near_dedup.variants(df), df, 10)
    assert split.groupBy("key").count().agg(F.max("count")).first()[0] < 0.1 * len(fps)


def by_component(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in map(tuple, links):
        parent[root(a)] = root(b)
    out = {}
    for x in parent:
        out.setdefault(root(x), set()).add(x)
    return out.values()
