"""Small cases for rules that a naive version gets wrong."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrweave.functions import arrays, cleaning
from corrweave.operators import graph, membership, returns, risk, trials
from corrweave.plans.queries import QUERIES
from corrweave.sources import raw, reports
from corrweave.streaming.prices import daily_prices


def day(n):
    return dt.date(2024, 1, n)


def test_a_gap_gives_no_return(spark):
    p = spark.createDataFrame([(day(1), "A", 1.0, 1.0), (day(2), "B", 1.0, 1.0), (day(3), "A", 2.0, 1.0), (day(4), "A", 4.0, 1.0), (day(5), "A", 0.0, 1.0)], "date date, ticker string, price double, volume double")
    got = {(r.date, r.ticker): r.ret for r in returns.log_returns(p).collect()}
    assert got[day(3), "A"] is None and got[day(5), "A"] is None and abs(got[day(4), "A"] - 0.6931471805599453) < 1e-12


def test_latest_row_is_taken_whole(spark):
    facts = spark.createDataFrame([(day(1), "A", 1.0, 5.0), (day(3), "A", None, 7.0)], "date date, ticker string, a double, b double")
    grid = spark.createDataFrame([(day(2), "A"), (day(4), "A"), (day(4), "B")], "date date, ticker string")
    got = {(r.date, r.ticker): (r.a, r.b) for r in membership.fundamentals_asof(facts, grid, ["a", "b"]).collect()}
    assert got == {(day(2), "A"): (1.0, 5.0), (day(4), "A"): (None, 7.0), (day(4), "B"): (None, None)}


def test_cleaning(spark):
    df = spark.createDataFrame([("aapl R735QTJ8XC9X", "1Y:x;3M:0.4", "01/02/2024"), ("$$", "junk", "x"), (None, "1Y:0.2;1Y:0.3", None)], "t string, d string, w string")
    got = df.select(cleaning.clean_ticker(F.col("t")), cleaning.packed_ratio(F.col("d")), cleaning.coerce_date(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [("AAPL", 0.4, dt.date(2024, 1, 2)), (None, None, None), (None, 0.3, None)]


def test_adjusted_close_falls_back_as_a_whole(spark):
    rows = [("2024-01-01", "a", "1", ""), ("2024-01-02", "a", "2", "5")]
    df = spark.createDataFrame(rows, "Date string, Symbol string, close string, `Adj Close` string")
    assert sorted((r.close, r.adj_close) for r in raw.standardize_prices(df).collect()) == [(1.0, None), (2.0, 5.0)]
    assert [r.adj_close for r in raw.standardize_prices(df.limit(1)).collect()] == [1.0]


def test_constituent_flags_and_caps(spark):
    df = spark.createDataFrame([("2024-01-01", "a", "x"), ("2024-01-01", "b", "0.5")], "date string, ticker string, included string")
    c = raw.standardize_constituents(df)
    assert sorted((r.ticker, r.is_member) for r in c.collect()) == [("A", 1), ("B", 0)]
    caps = spark.createDataFrame([(day(1), "A", 1.0), (day(1), "A", 2.0)], "date date, ticker string, market_cap double")
    assert raw.merge_market_cap(c, caps).count() == 3 and raw.merge_market_cap(c, caps, dedupe=True).count() == 2


def test_bins_with_ties_and_upper_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9)], "v double")
    got = [r.decile for r in risk.quantile_bins(df, "v").orderBy("v").collect()]
    assert got[:4] == [0] * 4 and max(got) == len(set(got)) - 1
    assert df.agg(risk.upper_median("v")).first()[0] == 4.0


def test_frontier_is_not_the_nondominated_set(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1), (2, 2.0, 0.5), (3, 3.0, 0.3)], "trial_id int, s double, q double")
    assert [r.trial_id for r in trials.frontier_prefix_max(df, "s", "q").orderBy("trial_id").collect()] == [1, 2]
    assert [r.trial_id for r in trials.pareto(df, "s", "q").orderBy("trial_id").collect()] == [2, 3]


def test_settings(tmp_path):
    f = tmp_path / "a.toml"
    f.write_text("[a]\nx = 1\n\n[b]\ny = 2\n")
    copy = reports.update_settings(str(f), "a", {"x": 3, "z": "k"})
    assert reports.load_settings(str(f), "a") == {"x": 3, "z": "k"} and reports.load_settings(copy, "a") == {"x": 1}
    assert reports.load_settings(str(f), "b") == {"y": 2} and reports.setting("q", None, {"q": "none"}, 5) is None


def test_stream_of_trades(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 9), "A", 1.0, 2.0), (dt.datetime(2024, 1, 1, 17), "A", 3.0, 2.0), (dt.datetime(2024, 1, 9, 9), "A", 5.0, 1.0)]
    spark.createDataFrame(rows, "ts timestamp, ticker string, price double, volume double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, ticker string, price double, volume double").parquet(str(tmp_path / "in"))
    q = daily_prices(s).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.date, r.price, r.volume) for r in spark.table("daily").collect()][:1] == [(day(1), 3.0, 4.0)]


def test_pareto_of_close_speeds(spark):
    df = spark.createDataFrame([(1, 10.0, 0.5), (2, 10.5, 0.6), (3, 10.5, 0.6), (4, 10.5, 0.1), (5, 11.0, 0.2), (6, None, 0.9), (7, 12.0, None)], "trial_id int, s double, q double")
    assert [r.trial_id for r in trials.pareto(df, "s", "q").orderBy("trial_id").collect()] == [2, 3, 5]
    assert trials.pareto(df.limit(0), "s", "q").count() == 0


def test_scans_over_ranges(spark):
    rows = [((i * 7919) % 997, i, float((i * 31) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    order = sorted(rows)
    assert {(r.k, r.i): r["rank"] for r in trials.ranked(df, "k", "i").collect()} == {(k, i): n + 1 for n, (k, i, _) in enumerate(order)}
    top, want = float("-inf"), {}
    for k, i, v in order:
        want[k, i], top = top, max(top, v)
    assert {(r.k, r.i): r["__top"] for r in trials.so_far(df, ["k", "i"], "v").collect()} == want


def test_summary_as_text(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1), (2, 2.0, 0.5), (3, 3.0, 0.3)], "trial_id int, s double, q double")
    text = trials.summary_text(trials.summary(df, "q", "s", "q", 2), ["trial_id", "q"])
    assert text == "best:\n  trial_id=2, q=0.5\ntop:\n  trial_id=2, q=0.5\n  trial_id=3, q=0.3\nfrontier:\n  trial_id=1, q=0.1\n  trial_id=2, q=0.5\n"


def test_choosing_graphs(spark):
    graphs = spark.createDataFrame([(0, day(1)), (1, day(2)), (2, day(3))], "graph_idx int, date date")
    nodes = spark.createDataFrame([(day(1), "A"), (day(2), "B")], "date date, ticker string")
    assert [r.graph_idx for r in trials.chosen(graphs, dates=[day(3), day(1), day(3)]).orderBy("graph_idx").collect()] == [0, 2]
    assert trials.chosen(graphs).count() == 3 and trials.chosen(graphs, n=2, seed=1).count() == 2
    with pytest.raises(ValueError, match="graph_idx 9"):
        trials.chosen(graphs, indices=[1, 9])
    assert [r.graph_idx for r in trials.holding(graphs, nodes, "B").collect()] == [1]
    with pytest.raises(ValueError, match="there are A, B"):
        trials.holding(graphs, nodes, "C")
    assert [trials.nth_graph(graphs, i).first().graph_idx for i in (-5, 1, 9)] == [0, 1, 2]


def test_a_security_id_never_outdoes_a_symbol(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2")], "Symbol string, SID string")
    assert raw.infer_ticker(df) == "Symbol" and raw.infer_ticker(df.select("SID")) == "SID"


def test_adjusted_close_of_a_row_without_keys_counts(spark):
    df = spark.createDataFrame([("2024-01-01", "a", "1", None), (None, None, "2", "5")], "date string, ticker string, close string, adj_close string")
    assert [r.adj_close for r in raw.standardize_prices(df).collect()] == [None]


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n3,4\n"), ("c.csv", "x,y\n5,6\n"), ("no.csv", "x,y\n7,8\n")):
        (tmp_path / name).write_text(text)
    df = raw.scan_dir(spark, str(tmp_path), exclude=("no.csv",))
    assert sorted((r.x, r.y) for r in df.collect()) == [("1", "2"), ("4", "3"), ("5", "6")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_empty_reports_are_errors(spark):
    with pytest.raises(ValueError):
        reports.load_rows(spark.createDataFrame([], "a string"))


def test_window_arithmetic_is_done_once(spark):
    """Mean and deviation stand outside the lambda over the elements: with 8,000 of them a nested one would take minutes."""
    df = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: (x * x % 977).cast("double")).alias("w"))
    began = time.perf_counter()
    z = df.select(arrays.z_score(F.col("w")).alias("z")).select(arrays.mean(F.col("z")).alias("m"), arrays.deviation(F.col("z")).alias("s")).first()
    assert abs(z.m) < 1e-9 and abs(z.s - 1) < 1e-6 and time.perf_counter() - began < 30


@pytest.mark.parametrize("name", ["merge_years", "scan_dir_union", "scan_recursive"])
def test_no_one_task_writes_all_rows(spark, tiny, name):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert len(QUERIES[name](spark, tiny).inputFiles()) > 2
    finally:
        spark.conf.unset(key)


def test_edge_corr_loss_takes_known_ends_alone(spark):
    at = day(1)
    x = np.random.default_rng(8).normal(size=(3, 6))
    nodes = spark.createDataFrame([(at, f"T{i}", v.tolist()) for i, v in enumerate(x)], "date date, ticker string, x array<double>")
    edges = spark.createDataFrame([(at, "T0", "T1", 0.5), (at, "T2", "T0", -0.25), (at, "T1", "gone", 0.1), (at, "T1", "T2", None)], "date date, src string, dst string, corr double")
    z = (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, ddof=1, keepdims=True) + 1e-6)
    want = (((z[0] * z[1]).mean() - 0.5) ** 2 + ((z[2] * z[0]).mean() + 0.25) ** 2) / 2
    found = graph.edge_corr_loss(edges, nodes)
    assert [r.date for r in found.collect()] == [at] and np.isclose(found.first().loss, want)
    assert "MapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_strip_takes_white_space_of_any_kind(spark):
    odd = [" \t1.5\r\n", "\x0b\x0c-2 ", "1 5", " 7", "", "  ", None, "nan", "3d"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v string")
    by_pattern = F.regexp_replace("v", r"^\s+|\s+$", "")
    got = rows.select("i", cleaning.strip(F.col("v")).alias("s"), by_pattern.alias("p"), cleaning.number(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.s for r in got] == [r.p for r in got] and [r.n for r in got][:4] == [1.5, -2.0, None, None]
    plan = rows.select(cleaning.number(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # a pattern for each value was most of the reading of a book


def test_computed_arrays_are_made_once_where_they_are_unrolled(spark, tiny):
    from corrweave.plans import panel

    for name in ("denormalize", "node_zscore"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        filters = [x for x in plan.splitlines() if " Filter " in f" {x}" and "lambda" in x]
        assert not filters, name
    plan = panel.book(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("collect_list") == 1  # the windows once for both series
