"""Exact quantiles over ranges against numpy, histograms and their scans, one ticker out of raw files."""

import datetime
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corrweave.operators import calibrate, learning, quantiles, risk
from corrweave.plans import panel
from corrweave.sources import raw


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_are_the_linear_ones(spark, n):
    """With a value that a third of all rows have, nulls, infinities and two columns of unlike counts."""
    r = np.random.default_rng(n)
    a = [0.25 if i % 3 == 0 else float(x) for i, x in enumerate(r.normal(size=n))]
    b = [None if i % 2 else float(x) for i, x in enumerate(r.integers(-5, 5, n))]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(3)
    p = [0.0, 0.01, 0.1, 0.33, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.quantiles(df, {"x": F.col("a"), "y": F.abs("b")}, p).first()
    assert np.allclose(got["x"], np.quantile(a, p), atol=1e-12) and np.allclose(got["y"], np.quantile([abs(v) for v in b if v is not None], p), atol=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = quantiles.quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5]).first()
    assert (got["a"], got["b"]) == (None, [1.0])
    empty = quantiles.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]).collect()
    assert len(empty) == 1 and empty[0]["a"] is None
    assert risk.quantile_bins(df, "a").select("decile").first()[0] is None


def test_no_task_holds_a_column(spark):
    """The wanted ranks lie in a few ranges, and only their rows are ranked."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    plan = quantiles.quantiles(df, {"v": F.col("v")}, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "BroadcastHint" not in plan.split("Window")[0]
    assert quantiles.quantiles(df, {"v": F.col("v")}, [0.5]).first()["v"] == [float(np.median([i * 7919 % 20_011 for i in range(20_000)]))]


def test_upper_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [4.0, 1.0, 2.0, 3.0], []):
        df = spark.createDataFrame([(v,) for v in values + [None]], "hall_minus_target double")
        assert risk.hit_summary(df, 2.0).first()["median_diff"] == (sorted(values)[len(values) // 2] if values else None)


def test_histograms_scan_twice(spark):
    r = np.random.default_rng(1)
    pairs = [(float(a), float(a * 1.3 + 0.1)) for a in r.normal(size=500)] + [(None, 1.0), (0.0, None)]
    df = spark.createDataFrame(pairs, "real double, halluc double")
    rows = calibrate.histograms(df, 10)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the range came before
    a, b = ([p[i] for p in pairs if p[i] is not None] for i in (0, 1))
    got = rows.orderBy("bin").collect()
    for name, x in (("real", a), ("halluc", b)):
        assert [g[name] for g in got] == np.histogram(x, 10, (min(a), max(a)))[0].tolist()
    assert [r.real for r in calibrate.histograms(df.limit(0), 3).collect()] == [0, 0, 0]
    flat = calibrate.histograms(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "real double, halluc double"), 3)
    assert [(g.real, g.halluc) for g in flat.orderBy("bin").collect()] == [(2, 1), (0, 0), (0, 0)]


def test_one_ticker_out_of_raw_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Symbol,Close\n2020-01-01, aa ,1.5\n2020-01-02,AA,\n2020-01-03,AA,n/a\n2020-01-04,AAB,9\nbad,AA,3\n2020-01-05,AA,nan\n2020-01-01,AA,7\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text('Close,Adj Close,ticker,date\n1,2.5,"AA",2020-01-06\n1,,AA,2020-01-07\n3,4,BB,2020-01-06\n')
    (tmp_path / "empty.csv").write_text("")
    got = {r.date: r.price for r in raw.scan_ticker(spark, str(tmp_path), "aa").collect()}
    assert got == {datetime.date(2020, 1, 1): 1.5, datetime.date(2020, 1, 6): 2.5}
    assert raw.scan_ticker(spark, str(tmp_path), "ZZ").count() == 0
    with pytest.raises(FileNotFoundError):
        raw.scan_ticker(spark, str(tmp_path / "sub"), "AA", "*.txt")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        raw.scan_ticker(spark, str(tmp_path), "AA")


def test_deciles_bin_the_goodness_their_edges_come_from(spark, tmp_path):
    """Rows whose sums differ by a last bit whenever they are made: 21 of them, so that every second one is an edge."""
    made = tmp_path / "made"
    made.mkdir()

    def rows(batches):
        for b in batches:
            (made / uuid.uuid4().hex).touch()
            more = 1 + 2.0**-52 * len(list(made.iterdir()))
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([{"goodness": (1 + r["id"]) * more, "fwd_dd_3": float(r["id"]), "fwd_vol_3": 0.0, "fwd_ret_3": 0.0}])

    df = spark.range(21).coalesce(1).mapInArrow(rows, "goodness double, fwd_dd_3 double, fwd_vol_3 double, fwd_ret_3 double")
    got = {r.decile: r.avg_drawdown for r in risk.goodness_quantiles(df, [3]).collect()}
    assert got == {0: 1.0, **{i: 2 * i + 1.5 for i in range(1, 10)}}


def test_goodness_in_any_order_of_rows(spark):
    r = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, [float(v) for v in r.normal(size=3)]) for i in range(2000)], "id int, x array<double>").withColumn("date", F.lit("2020-01-01"))
    got = {learning.goodness(nodes.orderBy(F.xxhash64("id", F.lit(seed))).coalesce(1)).first()["goodness"] for seed in range(8)}
    assert len(got) == 1
    x = np.array([n.x for n in nodes.collect()])
    assert np.isclose(got.pop(), np.log(np.exp((x * x).mean(axis=1)).sum()), rtol=1e-13)


def test_whole_cents_and_no_shuffle_to_the_calendar(spark, tiny):
    """Halves go away from zero as by `round`, without its decimals; prices meet the calendar where they are."""
    values = [0.0, 0.49999999999999994, 0.5, -0.5, 1.5, 2.5, -2.5, 4503599627370497.5, -0.49999999999999994, 105000.49999999999, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.a for r in df.select(panel.whole(F.col("v")).alias("a")).collect()] == [r.b for r in df.select(F.round("v").cast("bigint").alias("b")).collect()]
    plan = panel.returns_of(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "round(" not in plan
