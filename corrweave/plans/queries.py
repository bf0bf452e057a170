"""A query for each operator over the panel, and the SQL that gives the same rows. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, cleaning
from ..learn import jobs, kernels
from ..operators import calibrate, features, graph, learning, membership, returns, risk, trials
from ..sources import raw, reports
from ..sources.storage import shared_path, stored
from . import panel
from .panel import BENCHMARK, HORIZONS, MIN_NODES, RSI, TOP_K, WINDOW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if it has one."""

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return keep


def unrolled(df: DataFrame, array: str | Column, at: str, value: str, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """A row for each element. A plain explode has the optimizer ask for the array's size first, by which a computed array is made twice."""
    return df.select(*keys, F.posexplode_outer(array).alias(at, value)).where(F.col(at).isNotNull())


def _r(**columns: str) -> str:
    """Columns rounded to six places, never minus zero."""
    return ", ".join(f"round({e}, 6) + 0e0 AS {n}" for n, e in columns.items())


def _with(parts: str, body: str) -> str:
    """The named parts and all that they rest on, then the body."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in _PARTS[name][0].split():
            add(other)
        if name not in need:
            need.append(name)

    for p in parts.split():
        add(p)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in need) + ("" if body.startswith(",") else "\n") + body


_PARTS = {
    "prices": ("", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume, l_suppkey AS suppkey FROM lineitem GROUP BY 1, 2, l_suppkey"),
    "calendar": ("prices", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM prices)"),
    "returns": ("calendar", "SELECT date, i, ticker, volume, CASE WHEN i - lag(i) OVER w = 1 THEN ln(price / lag(price) OVER w) END AS ret FROM prices JOIN calendar USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY i)"),
    "spans": ("returns", "SELECT e.i, e.date, r.ticker, r.i - e.i + 19 AS t, r.ret, r.volume FROM calendar e JOIN returns r ON r.i BETWEEN e.i - 19 AND e.i WHERE e.i >= 19"),
    "whole": ("spans", "SELECT date, ticker, avg(ret) AS m, stddev_pop(ret) AS s FROM spans GROUP BY ALL HAVING count(ret) = 20"),
    "win": ("whole", "SELECT spans.*, m, s FROM spans JOIN whole USING (date, ticker)"),
    "corr": ("win", "SELECT a.date, a.ticker AS src, b.ticker AS dst, sum((a.ret - a.m) / (a.s + 1e-8) * (b.ret - b.m) / (b.s + 1e-8)) / 19 AS corr FROM win a JOIN win b ON a.date = b.date AND a.t = b.t AND a.ticker < b.ticker GROUP BY ALL"),
    "twoway": ("corr", "SELECT * FROM corr UNION ALL SELECT date, dst, src, corr FROM corr"),
    "picked": ("twoway", "SELECT * FROM twoway QUALIFY row_number() OVER (PARTITION BY date, src ORDER BY abs(corr) DESC, dst) <= 5"),
    "edges": ("picked", "SELECT DISTINCT ON (date, src, dst) * FROM (SELECT * FROM picked UNION ALL SELECT date, dst, src, corr FROM picked)"),
    "degree": ("edges", "SELECT date, dst AS node, sum(abs(corr)) AS d FROM edges GROUP BY ALL"),
    "norm": ("degree", "SELECT e.*, abs(corr) / (sqrt(a.d) * sqrt(b.d)) AS edge_weight FROM edges e JOIN degree a ON a.date = e.date AND a.node = e.src JOIN degree b ON b.date = e.date AND b.node = e.dst"),
    "summary": ("win", "SELECT w.date, w.ticker, any_value(w.s) AS vol, sum(w.ret) AS momentum, CASE WHEN avg(w.volume) > 0 THEN arg_max(w.volume, w.t) / avg(w.volume) ELSE 1 END AS vol_shock, CASE WHEN w.ticker = 'S000001' THEN 1e0 WHEN count(b.ret) = 0 THEN 0e0 ELSE avg((w.ret - w.m) * (b.ret - b.m)) / (any_value(w.s + 1e-8) * any_value(b.s + 1e-8)) END AS beta, 1e2 - 1e2 / (1 + avg(greatest(w.ret, 0)) FILTER (w.t >= 6) / (avg(greatest(-w.ret, 0)) FILTER (w.t >= 6) + 1e-8)) AS rsi FROM win w LEFT JOIN win b ON b.date = w.date AND b.t = w.t AND b.ticker = 'S000001' GROUP BY w.date, w.ticker"),
    "quarters": ("prices", "SELECT * FROM prices WHERE month(date) IN (1, 4, 7, 10)"),
    "constituents": ("quarters", "SELECT date, ticker, CAST(volume >= 150 AS INTEGER) AS is_member, n_name AS sector FROM quarters JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"),
    "members": ("constituents", "SELECT date, ticker FROM constituents WHERE is_member = 1"),
    "fundamentals": ("quarters", "SELECT date, ticker, CASE WHEN CAST(volume AS BIGINT) % 7 <> 0 THEN price / volume END AS pe_ratio, price / 1e3 AS pb_ratio, CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN 4e-1 WHEN CAST(volume AS BIGINT) % 11 = 0 THEN NULL ELSE CAST(CAST(volume AS BIGINT) % 10 AS DOUBLE) END AS debt_equity FROM quarters"),
    "filled": ("members calendar", "SELECT c.date, s.date AS source_date FROM calendar c LEFT JOIN (SELECT max(l.date) AS date, c.date AS at FROM calendar c JOIN members l ON l.date <= c.date GROUP BY c.date) s ON s.at = c.date AND c.date - s.date <= 40"),
    "book": ("win", "SELECT strftime(date, '%Y%m') AS scenario, 'real' AS series, ticker, t, ret AS r FROM win UNION ALL SELECT strftime(date, '%Y%m'), 'halluc', ticker, t, ret * 1.05e0 - 1e-3 FROM win"),
    "paths": ("book", "SELECT scenario, series, t, avg(r) AS r FROM book GROUP BY ALL"),
    "curves": ("paths", "SELECT *, cum / max(cum) OVER (PARTITION BY scenario, series ORDER BY t) - 1 AS drawdown FROM (SELECT *, exp(sum(r) OVER (PARTITION BY scenario, series ORDER BY t)) AS cum FROM paths)"),
    "tails": ("paths", "SELECT p.scenario, p.series, any_value(q) AS var, avg(r) FILTER (r <= q) AS cvar FROM paths p JOIN (SELECT scenario, series, quantile_cont(r, 0.05) AS q FROM paths GROUP BY ALL) USING (scenario, series) GROUP BY ALL"),
    "report": ("curves tails", "SELECT scenario, series, arg_max(cum, t) - 1 AS total_return, min(drawdown) AS max_drawdown, stddev_pop(r) AS volatility, any_value(var) AS var_95, any_value(cvar) AS cvar_95 FROM curves JOIN tails USING (scenario, series) GROUP BY ALL"),
    "energy": ("win", "SELECT date, ticker, avg(((ret - m) / (s + 1e-8) + 1) ** 2) AS e FROM win GROUP BY ALL"),
    "good": ("energy", "SELECT date, any_value(top) + ln(sum(exp(e - top))) AS goodness FROM (SELECT *, max(e) OVER (PARTITION BY date) AS top FROM energy) GROUP BY date"),
    "bench": ("prices", "SELECT date, ln(price / lag(price) OVER (ORDER BY date)) AS ret, row_number() OVER (ORDER BY date) AS n FROM prices WHERE ticker = 'S000001'"),
    "ahead": ("bench", "SELECT a.date, h, b.n - a.n AS k, b.ret, sum(b.ret) OVER (PARTITION BY a.date, h ORDER BY b.n) AS cum, count(*) OVER (PARTITION BY a.date, h) AS c FROM bench a, (VALUES (3), (6)) v(h), bench b WHERE b.n BETWEEN a.n + 1 AND a.n + h"),
    "forward": ("ahead", "SELECT date, h, stddev_pop(ret) AS vol, exp(min(cum - peak)) - 1 AS dd, exp(arg_max(cum, k)) - 1 AS ret FROM (SELECT *, max(cum) OVER (PARTITION BY date, h ORDER BY k) AS peak FROM ahead WHERE c = h) GROUP BY ALL"),
    "scored": ("good forward", "SELECT g.date, goodness, a.vol AS v3, a.dd AS d3, a.ret AS r3, b.vol AS v6, b.dd AS d6, b.ret AS r6 FROM good g JOIN forward a ON a.date = g.date AND a.h = 3 JOIN forward b ON b.date = g.date AND b.h = 6"),
    "values": ("win", "SELECT ret AS real, ret * 1.05e0 - 1e-3 AS halluc FROM win"),
    "bounds": ("values", "SELECT min(real) AS lo, max(real) AS hi FROM values"),
    "hist": ("bounds", "SELECT k.bin, coalesce(a.n, 0) AS real, coalesce(b.n, 0) AS halluc FROM (SELECT unnest(range(1, 61)) AS bin) k LEFT JOIN (SELECT least(CAST(floor((real - lo) / ((hi - lo) / 60)) AS INTEGER) + 1, 60) AS bin, count(*) AS n FROM values, bounds GROUP BY 1) a ON a.bin = k.bin LEFT JOIN (SELECT least(CAST(floor((halluc - lo) / ((hi - lo) / 60)) AS INTEGER) + 1, 60) AS bin, count(*) AS n FROM values, bounds WHERE halluc BETWEEN lo AND hi GROUP BY 1) b ON b.bin = k.bin"),
    "shares": ("hist", "SELECT (real / (sum(real) OVER () * w) + 1e-8) / (1 / w + 60e-8) AS p, (halluc / (sum(halluc) OVER () * w) + 1e-8) / (1 / w + 60e-8) AS q FROM hist, (SELECT (hi - lo) / 60 AS w FROM bounds)"),
    "diverge": ("shares", "SELECT sum(p * ln(p / q)) AS kl, sum(p * ln(2 * p / (p + q)) / 2 + q * ln(2 * q / (p + q)) / 2) AS js FROM shares"),
    "trials": ("", "SELECT o_orderkey AS trial_id, CASE WHEN o_orderkey % 1000 = 0 THEN 'ff_e2e' ELSE 'ff_layerwise' END AS mode, CAST(o_orderkey % 3 + 1 AS INTEGER) AS parallel_workers, CAST(o_orderkey * 7919 % 1009 AS DOUBLE) / 1e1 AS graphs_per_s, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 104729 % 1013 AS DOUBLE) / 1e3 END AS eval_sep FROM orders"),
    "bent": ("win", "SELECT date, ticker, sum(ret) AS real, sum(ret * 1.05e0 - 1e-3) AS halluc FROM win GROUP BY ALL"),
}

_TRIALS = f"trial_id, mode, parallel_workers, {_r(graphs_per_s='graphs_per_s', eval_sep='eval_sep')}"

# --- sources ---------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, kind: str, **frames: DataFrame) -> str:
    """Frames as CSV folders, one for each name, in the shared folder."""
    root = shared_path(spark, kind)
    for name, df in frames.items():
        df.write.csv(f"{root}/{name}", header=True)
    return root


def _panel_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.prices(spark, sf_dir)
    return p.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.lower("ticker").alias("ticker"), F.col("price").alias("close"), F.lit(None).cast("double").alias("adj close"), "volume")


@query(_with("prices", f"SELECT date, ticker, {_r(price='price')}, {_r(volume='volume')} FROM prices"))
def scan_prices(spark, sf_dir):
    root = _written(spark, "prices", one=_panel_csv(spark, sf_dir).withColumnRenamed("adj close", "other"))
    return raw.load_prices(raw.read_csv(spark, f"{root}/one"))


@query(_with("prices", f"SELECT date, ticker, {_r(price='price')}, {_r(volume='volume')} FROM prices"))
def scan_dir_union(spark, sf_dir):
    """Files whose headers differ in order are matched by name."""
    p = _panel_csv(spark, sf_dir)
    early = F.col("date") < "1995-01-01"
    root = _written(spark, "union", a=p.where(early), b=p.where(~early).select("volume", "close", "ticker", "date"))
    rows = raw.standardize_prices(raw.scan_dir(spark, root, "part-*.csv", recursive=True))
    return rows.select("date", "ticker", F.col("adj_close").alias("price"), "volume")


@query(_with("prices", "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM prices GROUP BY ALL"))
def scan_recursive(spark, sf_dir):
    p = _panel_csv(spark, sf_dir).select("date", "ticker")
    root = _written(spark, "years", y1=p.where("date < '1995-01-01'"), y2=p.where("date >= '1995-01-01'"))
    return raw.scan_dir(spark, root, "part-*.csv", recursive=True).groupBy(F.year(cleaning.coerce_date(F.col("date"))).alias("year")).agg(F.count("*").alias("n"))


@query(_with("members", "SELECT date, ticker FROM members"))
def scan_constituents(spark, sf_dir):
    root = _written(spark, "constituents", one=panel.constituents(spark, sf_dir))
    return raw.load_constituents(raw.read_csv(spark, f"{root}/one")).select("date", "ticker")


@query(_with("fundamentals", f"SELECT date, ticker, {_r(pe_ratio='pe_ratio', pb_ratio='pb_ratio', debt_equity='debt_equity')} FROM fundamentals"))
def scan_fundamentals(spark, sf_dir):
    root = _written(spark, "fundamentals", one=panel.fundamentals(spark, sf_dir))
    return raw.load_fundamentals(raw.read_csv(spark, f"{root}/one")).select("date", "ticker", "pe_ratio", "pb_ratio", "debt_equity")


@query(_with("trials", f"SELECT {_TRIALS} FROM trials"))
def scan_trials(spark, sf_dir):
    root = _written(spark, "trials", one=panel.trials(spark, sf_dir))
    return reports.load_trials(raw.read_csv(spark, f"{root}/one")).withColumns({"trial_id": F.col("trial_id").cast("bigint"), "parallel_workers": F.col("parallel_workers").cast("int")})


@query(_with("book", f"SELECT scenario, series, ticker, CAST(t AS INTEGER) AS t, {_r(r='r')} FROM book"))
def scan_pairs(spark, sf_dir):
    book = panel.book(spark, sf_dir).drop("date")
    root = _written(spark, "book", one=reports.spread(book, WINDOW))
    rows = reports.load_windows(raw.read_csv(spark, f"{root}/one"), ["scenario", "series", "ticker"])
    return rows.select("scenario", "series", "ticker", F.posexplode("w").alias("t", "r"))


@query(_with("prices", f"SELECT date, {_r(price='price')} FROM prices WHERE ticker = 'S000001'"))
def scan_ticker(spark, sf_dir):
    """One ticker out of raw files of two layouts, among rows without a price, with words for one, and of tickers that contain its name."""
    p = _panel_csv(spark, sf_dir).select("date", "ticker", F.col("close").cast("string").alias("close"))
    early = F.col("date") < "1995-01-01"
    odd = p.withColumn("close", F.when(F.month("date") % 2 == 0, F.lit("n/a")).otherwise(F.lit(" ")))
    longer = p.withColumn("ticker", F.concat("ticker", F.lit("0")))
    root = _written(spark, "ticker", a=p.where(early).unionByName(odd), b=p.where(~early).unionByName(longer).select("close", "ticker", "date"))
    return raw.scan_ticker(spark, root, BENCHMARK, "part-*.csv")


@query(_with("report", f"SELECT scenario, series, {_r(**{c: c for c in ('total_return', 'max_drawdown', 'volatility', 'var_95', 'cvar_95')})} FROM report"))
def write_read_csv(spark, sf_dir):
    """A report's CSV, columns in order of name, read again."""
    path = shared_path(spark, "report")
    reports.write_csv(risk.stress_report(panel.book(spark, sf_dir)), path, sort_columns=True)
    rows = reports.load_rows(raw.read_csv(spark, path)).drop("_file", "_line")
    return rows.select("scenario", "series", *[cleaning.number(F.col(c)).alias(c) for c in ("total_return", "max_drawdown", "volatility", "var_95", "cvar_95")])


@query(_with("values diverge", f"SELECT {_r(mae='avg(abs(halluc - real))', js_divergence='any_value(js)')} FROM values, diverge"))
def write_read_json(spark, sf_dir):
    path = shared_path(spark, "metrics")
    reports.write_json(calibrate.calibration(_values(spark, sf_dir)), path)
    return spark.read.schema("mae double, js_divergence double").json(path)


@query(_with("edges", f"SELECT date, src, dst, {_r(corr='corr')} FROM edges"))
def write_read_graphs(spark, sf_dir):
    """Nodes and edges under one folder, by year, and the edges of it read again."""
    path, w = shared_path(spark, "graphs"), panel.kept_windows(spark, sf_dir)
    reports.write_graphs(path, nodes=w.select("date", "ticker"), edges=graph.topk_edges(w, TOP_K))
    nodes, edges = reports.read_graphs(spark, path, "nodes", "edges")
    return edges.join(nodes.withColumnRenamed("ticker", "src"), ["date", "src"], "left_semi").select("date", "src", "dst", "corr")


@query(_with("book", f"SELECT scenario AS scenario_id, series, ticker, CAST(t AS INTEGER) AS t, {_r(r='r')} FROM book"))
def write_read_book(spark, sf_dir):
    path = shared_path(spark, "book")
    rows = panel.book(spark, sf_dir).withColumnsRenamed({"scenario": "scenario_id"}).withColumn("graph_index", F.col("scenario_id").cast("int"))
    reports.write_book(rows, path, WINDOW)
    found = reports.load_windows(raw.read_csv(spark, f"{path}/book"), ["scenario_id", "series", "ticker"])
    return found.select("scenario_id", "series", "ticker", F.posexplode("w").alias("t", "r"))


@query(_with("book", f"SELECT ticker, series, scenario AS t, {_r(total='sum(r)')} FROM book WHERE ticker IN ('S000001', 'S000002') GROUP BY ALL"))
def write_read_pairs(spark, sf_dir):
    path = shared_path(spark, "pairs")
    reports.write_pairs(panel.book(spark, sf_dir).withColumnRenamed("scenario", "t"), path, WINDOW, ["S000001", "S000002"])
    return reports.load_windows(raw.read_csv(spark, path)).select("ticker", "series", "t", arrays.total(F.col("w")).alias("total"))


@query(f"SELECT l_orderkey AS trial_id, CAST(l_linenumber AS INTEGER) AS epoch, {_r(loss='l_extendedprice')} FROM lineitem")
def append_read_log(spark, sf_dir):
    """What all epochs of all trials told, appended epoch by epoch half and read again."""
    path, log = shared_path(spark, "log"), _epochs(spark, sf_dir).select("trial_id", F.col("epoch").cast("int").alias("epoch"), F.col("graphs").alias("loss"))
    for early in (True, False):
        reports.append_log(spark, log.where((F.col("epoch") <= 3) == early), path)
    return spark.read.parquet(path)


@query("SELECT layer, name, n FROM (VALUES (0, 'weight', 320), (0, 'bias', 16), (1, 'weight', 256), (1, 'bias', 16)) v(layer, name, n)")
def write_read_model(spark, sf_dir):
    """A model trained on the panel as a table, written, read, made a model and a table again: how many values each part has, all as they were."""
    path = shared_path(spark, "model")
    layers, _ = jobs.train(_packed(spark, sf_dir), WINDOW, WINDOW, jobs.Training(hidden=16, epochs=1))
    before = jobs.model_table(spark, layers)
    before.write.parquet(path)
    after = jobs.model_table(spark, jobs.model_from(spark.read.parquet(path)))
    return after.join(before, ["layer", "name", "shape", "data"], "left_semi").select("layer", "name", F.size("data").alias("n"))


@query(_with("prices", f"SELECT date, ticker, {_r(close='price')} FROM prices"))
def merge_years(spark, sf_dir):
    """Yearly folders of all four kinds as one table each; the prices of them."""
    root, p = shared_path(spark, "merge"), stored(_panel_csv(spark, sf_dir).select("date", "ticker", "close"), "prices")
    for year, rows in (("y1", p.where("date < '1995-01-01'")), ("y2", p.where("date >= '1995-01-01'").select("close", "ticker", "date"))):
        for name in ("prices", "constituents", "fundamentals", "macro_prices"):
            df = rows.withColumnRenamed("date", "time") if name == "macro_prices" else rows.withColumnRenamed("ticker", "constituent_symbol") if name == "constituents" else rows
            df.write.csv(f"{root}/{year}/{name}.csv", header=True)
    merged = raw.merge_years(spark, root)
    return merged["prices"].select("date", "ticker", cleaning.number(F.col("close")).alias("close"))


# --- cleaning --------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_type AS raw, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def normalize_name(spark, sf_dir):
    return panel.table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"), cleaning.normalize_name(F.col("p_type")).alias("name")).distinct()


@query("SELECT 'symbol' AS ticker_column")
def infer_ticker(spark, sf_dir):
    """Of two symbol-like columns the one with more distinct values."""
    df = panel.prices(spark, sf_dir).select("date", F.lit("X").alias("ticker"), F.col("ticker").alias("symbol"))
    return spark.createDataFrame([(raw.infer_ticker(df),)], "ticker_column string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def coerce_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "M/d/yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("not a date")
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", cleaning.coerce_date(said).alias("date"))


@query("SELECT c_custkey, upper(c_mktsegment) AS ticker FROM customer")
def clean_ticker(spark, sf_dir):
    return panel.table(spark, sf_dir, "customer").select("c_custkey", cleaning.clean_ticker(F.concat(F.lit("\t $"), F.lower("c_mktsegment"), F.lit(" R735QTJ8XC9X"))).alias("ticker"))


@query(_with("fundamentals", f"SELECT date, ticker, {_r(debt_equity='debt_equity')} FROM fundamentals"))
def parse_debt_equity(spark, sf_dir):
    return panel.fundamentals(spark, sf_dir).select("date", "ticker", cleaning.packed_ratio(F.col("debt_equity")).alias("debt_equity"))


@query(_with("prices", f"SELECT date, ticker, {_r(close='price', adj_close='price', volume='volume')} FROM prices"))
def standardize_prices(spark, sf_dir):
    p = _panel_csv(spark, sf_dir)
    return raw.standardize_prices(p.unionByName(p).withColumnsRenamed({"date": "Time", "ticker": "Symbol", "close": "Close"})).select("date", "ticker", "close", "adj_close", "volume")


@query(_with("constituents", "SELECT date, ticker, is_member, sector FROM constituents"))
def standardize_constituents(spark, sf_dir):
    c = panel.constituents(spark, sf_dir).withColumnsRenamed({"date": "End", "ticker": "Constituent", "is_member": "Included", "sector": "GICS Sector"})
    return raw.standardize_constituents(c.unionByName(c)).select("date", "ticker", "is_member", "sector")


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.standardize_coarse(panel.prices(spark, sf_dir).select("date", F.col("ticker").alias("symbol"), (F.col("price") * F.col("volume")).alias("MktCap")))


@query(_with("prices", f"SELECT date, ticker, {_r(market_cap='price * volume')} FROM prices"))
def standardize_coarse(spark, sf_dir):
    return _coarse(spark, sf_dir)


@query(_with("prices", f"SELECT date, ticker, {_r(price='price')} FROM prices WHERE date BETWEEN DATE '1994-03-01' AND DATE '1995-02-01'"))
def date_range(spark, sf_dir):
    return returns.in_range(panel.prices(spark, sf_dir), "1994-03-01", "1995-02-01").select("date", "ticker", "price")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return panel.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def dedupe_first(spark, sf_dir):
    return membership.first_rows(panel.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")
def dedupe_last(spark, sf_dir):
    return membership.first_rows(panel.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_partkey")])


@query(_with("members", "SELECT * FROM members UNION SELECT date, t AS ticker FROM members, (VALUES ('S000001'), ('XTRA')) v(t)"))
def extra_tickers(spark, sf_dir):
    return membership.with_extra(panel.members(spark, sf_dir), ["S000001", "XTRA"])


@query(_with("win", "SELECT DISTINCT date FROM win WHERE ticker = 'S000001'"))
def graphs_with_ticker(spark, sf_dir):
    w = panel.windows(spark, sf_dir)
    return w.select("date").distinct().join(w.where(F.col("ticker") == BENCHMARK), "date", "left_semi")


@query(_with("win", "SELECT DISTINCT date FROM win WHERE date NOT IN (SELECT date FROM win WHERE ticker = 'S000007')"))
def missing_target_graphs(spark, sf_dir):
    w = panel.windows(spark, sf_dir)
    return w.select("date").distinct().join(w.where("ticker = 'S000007'"), "date", "left_anti")


@query(_with("win", "SELECT date FROM (SELECT DISTINCT date FROM win) WHERE date >= DATE '1995-01-01'"))
def select_scenarios(spark, sf_dir):
    w = panel.windows(spark, sf_dir).select("date").distinct()
    return w.where(F.col("date") >= F.lit("1995-01-01").cast("date"))


@query(_with("win", "SELECT date FROM (SELECT DISTINCT date FROM win) ORDER BY md5('7:' || CAST(date AS VARCHAR)), date LIMIT 10"))
def sampled_scenarios(spark, sf_dir):
    return trials.sampled(panel.windows(spark, sf_dir).select("date").distinct(), 10, 7, "date")


@query(_with("trials", "SELECT trial_id, CASE WHEN n * 8 // 10 >= k THEN 'train' ELSE 'eval' END AS part FROM (SELECT trial_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('7:' || CAST(trial_id AS VARCHAR)), trial_id) AS k FROM trials)"))
def train_eval_split(spark, sf_dir):
    """Which trial is in which part."""
    return trials.split(panel.trials(spark, sf_dir), key="trial_id")


def _graph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, graph_idx) of the dates with a window, counted on from 0. One row a date."""
    w = panel.windows(spark, sf_dir).select("date", "date_idx").distinct()
    return w.select("date", (F.col("date_idx") - (WINDOW - 1)).cast("int").alias("graph_idx"))


_GRAPHS = "SELECT DISTINCT date, CAST(i - 19 AS INTEGER) AS graph_idx FROM win"


@query(_with("win", f"SELECT * FROM ({_GRAPHS}) WHERE graph_idx IN (1, 5, 30)"))
def scenarios_by_index(spark, sf_dir):
    return trials.chosen(_graph_list(spark, sf_dir), indices=[5, 1, 30, 5]).select("date", "graph_idx")


@query(_with("win", f"SELECT * FROM ({_GRAPHS}) WHERE date IN (DATE '1999-01-01', DATE '1998-03-01')"))
def scenarios_by_date(spark, sf_dir):
    dates = [datetime.date(1999, 1, 1), datetime.date(1998, 3, 1)]
    return trials.chosen(_graph_list(spark, sf_dir), dates=dates).select("date", "graph_idx")


@query(_with("win", f"SELECT * FROM ({_GRAPHS}) WHERE graph_idx < 7"))
def first_graphs(spark, sf_dir):
    return trials.first_graphs(_graph_list(spark, sf_dir), 7)


@query(_with("win", f"SELECT * FROM ({_GRAPHS}) ORDER BY graph_idx DESC LIMIT 1"))
def clamped_graph(spark, sf_dir):
    """An index far beyond the last graph."""
    return trials.nth_graph(_graph_list(spark, sf_dir), 100_000).select("date", "graph_idx")


# --- joins -----------------------------------------------------------------------------------------------------------


@query(_with("constituents", f"SELECT c.date, ticker, {_r(market_cap='price * volume')} FROM constituents c JOIN prices p USING (date, ticker)"))
def merge_market_cap(spark, sf_dir):
    return raw.merge_market_cap(panel.constituents(spark, sf_dir), _coarse(spark, sf_dir)).select("date", "ticker", "market_cap")


@query(_with("members", "SELECT date, ticker FROM members"))
def membership_exact(spark, sf_dir):
    return membership.members_exact(panel.members(spark, sf_dir), panel.prices(spark, sf_dir))


@query(_with("filled", "SELECT f.date, m.ticker FROM filled f JOIN members m ON m.date = f.source_date"))
def membership_ffill(spark, sf_dir):
    return membership.members_filled(panel.members(spark, sf_dir), panel.prices(spark, sf_dir), 40)


@query(_with("filled", "SELECT count(*) FILTER (f.source_date = f.date) AS source_dates, count(*) FILTER (f.source_date <> f.date) AS filled_dates, CAST(count_if(f.source_date IS NULL AND f.date >= (SELECT min(date) FROM members)) AS BIGINT) AS gap_dropped FROM filled f"))
def membership_fill_stats(spark, sf_dir):
    return membership.fill_stats(panel.members(spark, sf_dir), panel.prices(spark, sf_dir), 40)


@query(_with("returns", "SELECT d.date, t.ticker FROM (SELECT DISTINCT date FROM returns) d, (SELECT DISTINCT ticker FROM returns) t"))
def membership_all(spark, sf_dir):
    return membership.members_all(panel.returns_of(spark, sf_dir))


@query(_with("fundamentals", f"SELECT p.date, p.ticker, {_r(pe_ratio='f.pe_ratio', pb_ratio='f.pb_ratio', debt_equity='f.debt_equity')} FROM prices p ASOF LEFT JOIN fundamentals f ON p.ticker = f.ticker AND p.date >= f.date"))
def fundamentals_asof(spark, sf_dir):
    f = raw.load_fundamentals(panel.fundamentals(spark, sf_dir))
    return membership.fundamentals_asof(f, panel.prices(spark, sf_dir), ["pe_ratio", "pb_ratio", "debt_equity"])


@query(_with("returns members", f"SELECT r.date, r.ticker, {_r(ret='ret')} FROM returns r SEMI JOIN members m USING (date, ticker)"))
def member_returns(spark, sf_dir):
    return panel.returns_of(spark, sf_dir).join(panel.members(spark, sf_dir), ["date", "ticker"], "left_semi").select("date", "ticker", "ret")


@query(_with("win fundamentals", f"SELECT DISTINCT w.date, w.ticker, {_r(pb_ratio='f.pb_ratio')} FROM win w LEFT JOIN fundamentals f USING (date, ticker)"))
def node_fundamentals(spark, sf_dir):
    return panel.windows(spark, sf_dir).select("date", "ticker").join(panel.fundamentals(spark, sf_dir).select("date", "ticker", "pb_ratio"), ["date", "ticker"], "left")


@query(_with("corr", f"SELECT date, src, dst, {_r(corr='corr')} FROM corr"))
def rolling_corr(spark, sf_dir):
    return graph.corr_pairs(panel.windows(spark, sf_dir))


@query(_with("win bench", f"SELECT DISTINCT w.date, {_r(ret='b.ret')} FROM win w LEFT JOIN bench b USING (date)"))
def benchmark_join(spark, sf_dir):
    dates = panel.windows(spark, sf_dir).select("date").distinct()
    r = panel.returns_of(spark, sf_dir).where(F.col("ticker") == BENCHMARK).select("date", "ret")
    return dates.join(r, "date", "left")


@query(_with("book", f"SELECT scenario, ticker, CAST(book.t AS INTEGER) AS t, {_r(real='max(r) FILTER (series = $$real$$)', halluc='max(r) FILTER (series = $$halluc$$)')} FROM book GROUP BY scenario, ticker, book.t HAVING count(DISTINCT series) = 2".replace("$$", "'")))
def pair_real_halluc(spark, sf_dir):
    pairs = calibrate.paired(panel.book(spark, sf_dir), ["scenario", "ticker"])
    return pairs.select("scenario", "ticker", F.posexplode(F.arrays_zip("real", "halluc")).alias("t", "p")).select("scenario", "ticker", "t", "p.*")


_GRID_SQL = """
WITH x AS (SELECT DISTINCT l_discount AS a FROM lineitem), y AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS s FROM lineitem), z AS (SELECT DISTINCT l_tax AS l FROM lineitem)
SELECT CAST(row_number() OVER (ORDER BY a, s, l, k) - 1 AS INTEGER) AS trial_id, CAST(row_number() OVER (ORDER BY a, s, l, k) + 6 AS INTEGER) AS seed, m AS mode, a AS goodness_temp, s AS hall_steps, l AS hall_lr
FROM x, y, z, (VALUES (0, 'ff_layerwise'), (1, 'ff_e2e')) w(k, m)
"""


@query(_GRID_SQL)
def param_grid(spark, sf_dir):
    """The grid over all values that three columns of the lines take, in order."""
    lines = panel.table(spark, sf_dir, "lineitem")
    found = lines.agg(*[F.array_sort(F.collect_set(F.col(c).cast(t))).alias(name) for name, c, t in (("goodness_temp", "l_discount", "double"), ("hall_steps", "l_linenumber", "int"), ("hall_lr", "l_tax", "double"))]).first()
    return trials.param_grid(spark, found.asDict(), ["ff_layerwise", "ff_e2e"], seed=7)


# --- windows and features --------------------------------------------------------------------------------------------


@query(_with("prices", f"SELECT date, {_r(S000001='max(price) FILTER (ticker = $$S000001$$)', S000002='max(price) FILTER (ticker = $$S000002$$)')} FROM prices WHERE ticker IN ('S000001', 'S000002') GROUP BY date".replace("$$", "'")))
def pivot_prices(spark, sf_dir):
    return returns.pivoted(panel.prices(spark, sf_dir), ["S000001", "S000002"])


@query(_with("returns", f"SELECT date, ticker, {_r(ret='ret', volume='volume')} FROM returns"))
def log_returns(spark, sf_dir):
    return panel.returns_of(spark, sf_dir).drop("date_idx")


@query(_with("calendar", "SELECT date, CAST(i AS INTEGER) AS date_idx FROM calendar WHERE i >= 19 AND (i - 19) % 3 = 0"))
def window_ends(spark, sf_dir):
    return returns.window_ends(panel.prices(spark, sf_dir), WINDOW, 3)


@query(_with("win", f"SELECT date, ticker, CAST(t AS INTEGER) AS t, {_r(ret='ret', volume='volume')} FROM win"))
def complete_windows(spark, sf_dir):
    return panel.windows(spark, sf_dir).select("date", "ticker", F.posexplode(F.arrays_zip(F.col("w").alias("ret"), F.col("v").alias("volume"))).alias("t", "x")).select("date", "ticker", "t", "x.ret", "x.volume")


_STATUS = _with("whole members", "SELECT c.date, CAST(c.i AS INTEGER) AS date_idx, coalesce(n, 0) AS num_nodes, CASE WHEN c.date NOT IN (SELECT date FROM members) THEN 'no_members' WHEN coalesce(n, 0) < 5 THEN 'min_nodes' ELSE 'ok' END AS status FROM calendar c LEFT JOIN (SELECT date, count(*) AS n FROM whole SEMI JOIN members USING (date, ticker) GROUP BY date) USING (date) WHERE c.i >= 19")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = panel.returns_of(spark, sf_dir)
    return returns.window_status(r, returns.complete_windows(r, WINDOW), panel.members(spark, sf_dir), WINDOW, min_nodes=MIN_NODES)


@query(_STATUS)
def window_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query(f"SELECT count(*) AS total_windows, count(*) FILTER (status = 'no_members') AS skipped_no_members, 0::BIGINT AS skipped_no_cols, count(*) FILTER (status = 'min_nodes') AS skipped_min_nodes, 0::BIGINT AS skipped_no_edges, count(*) FILTER (status = 'ok') AS built FROM ({_STATUS})")
def build_stats(spark, sf_dir):
    return returns.build_stats(_status(spark, sf_dir))


@query(_with("summary", f"SELECT date, ticker, {_r(**{c: c for c in features.SUMMARY})} FROM summary"))
def summary_features(spark, sf_dir):
    return features.summaries(panel.windows(spark, sf_dir), BENCHMARK, RSI).select("date", "ticker", *features.SUMMARY)


@query(_with("win", f"SELECT date, ticker, CAST(t AS INTEGER) AS t, {_r(z='(ret - m) / (s + 1e-8)')} FROM win"))
def node_zscore(spark, sf_dir):
    return unrolled(panel.windows(spark, sf_dir), arrays.z_score(F.col("w")), "t", "z")


@query(_with("summary", f"SELECT date, ticker, {_r(**{c: f'({c} - avg({c}) OVER (PARTITION BY date)) / (stddev_pop({c}) OVER (PARTITION BY date) + 1e-8)' for c in features.SUMMARY})} FROM summary"))
def xs_zscore(spark, sf_dir):
    return features.cross_section(features.summaries(panel.windows(spark, sf_dir), BENCHMARK, RSI), features.SUMMARY).select("date", "ticker", *features.SUMMARY)


@query(_with("fundamentals", f"SELECT date, ticker, {_r(**{c: f'coalesce({c}, median({c}) OVER (PARTITION BY date), 0)' for c in ('pe_ratio', 'debt_equity')})} FROM fundamentals"))
def fund_impute(spark, sf_dir):
    f = raw.load_fundamentals(panel.fundamentals(spark, sf_dir))
    return features.impute(f, ("pe_ratio", "debt_equity")).select("date", "ticker", "pe_ratio", "debt_equity")


def _nodes(spark: SparkSession, sf_dir: str, mode: str = "window") -> DataFrame:
    f = raw.load_fundamentals(panel.fundamentals(spark, sf_dir)) if mode.endswith("fund") else None
    return features.node_features(panel.windows(spark, sf_dir), mode, BENCHMARK, RSI, fundamentals=f)


_FUND = ("pe_ratio", "debt_equity", "pb_ratio")
_V = range(len(features.SUMMARY) + len(_FUND))
_MEDIANS = f"SELECT date, {', '.join(f'median(f.{c}) AS {c}' for c in _FUND)} FROM summary LEFT JOIN fundamentals f USING (date, ticker) GROUP BY date"
_WIDE = f"SELECT s.date, s.ticker, {', '.join(f's.{c} AS v{i}' for i, c in enumerate(features.SUMMARY))}, {', '.join(f'coalesce(f.{c}, m.{c}, 0) AS v{5 + i}' for i, c in enumerate(_FUND))} FROM summary s LEFT JOIN fundamentals f ON f.date = s.date AND f.ticker = s.ticker JOIN medians m ON m.date = s.date"
_MOMENTS = f"SELECT date, {', '.join(f'avg(v{i}) AS a{i}, stddev_pop(v{i}) AS s{i}' for i in _V)} FROM wide GROUP BY date"
_DIMS = f"SELECT date, ticker, {', '.join(f'(v{i} - a{i}) / (s{i} + 1e-8) AS d{20 + i}' for i in _V)} FROM wide JOIN moments USING (date)"
_NODE_SQL = f""", medians AS MATERIALIZED ({_MEDIANS}), wide AS MATERIALIZED ({_WIDE}), moments AS MATERIALIZED ({_MOMENTS}), scored AS MATERIALIZED ({_DIMS}),
dims AS (SELECT date, ticker, CAST(t AS INTEGER) AS dim, ret AS x FROM win UNION ALL SELECT date, ticker, CAST(substr(name, 2) AS INTEGER), value FROM (UNPIVOT scored ON COLUMNS('d2[0-9]') INTO NAME name VALUE value))
SELECT date, ticker, 28 AS width, dim, {_r(value='x')} FROM dims"""


@query(_with("summary fundamentals", _NODE_SQL))
def node_features(spark, sf_dir):
    """The widest mode, as long rows."""
    return _nodes(spark, sf_dir, "window_plus_summary_fund").select("date", "ticker", F.size("x").alias("width"), F.posexplode("x").alias("dim", "value"))


# --- edges -----------------------------------------------------------------------------------------------------------


@query(_with("edges", f"SELECT date, src, dst, {_r(corr='corr')} FROM edges"))
def topk_edges(spark, sf_dir):
    return graph.topk_edges(panel.windows(spark, sf_dir), TOP_K)


@query(_with("edges", f"SELECT date, src, dst, {_r(corr='corr')} FROM edges"))
def topk_edges_matrix(spark, sf_dir):
    return graph.topk_edges(panel.windows(spark, sf_dir), TOP_K)


@query(_with("twoway", f"SELECT date, src, dst, {_r(corr='corr')} FROM twoway WHERE abs(corr) >= 6e-1"))
def threshold_edges(spark, sf_dir):
    return graph.threshold_edges(panel.windows(spark, sf_dir), 0.6)


@query(_with("edges", f"SELECT date, src, dst, {_r(weight_abs='abs(corr)', weight_raw='corr', weight_ones='1e0')} FROM edges"))
def edge_weight_mode(spark, sf_dir):
    e = graph.topk_edges(panel.windows(spark, sf_dir), TOP_K)
    return e.select("date", "src", "dst", *[graph.edge_weight(F.col("corr"), m).alias(f"weight_{m}") for m in ("abs", "raw", "ones")])


@query(_with("norm", f"SELECT date, src, dst, {_r(edge_weight='edge_weight')} FROM norm"))
def gcn_norm(spark, sf_dir):
    return jobs.edge_table(panel.windows(spark, sf_dir), TOP_K).select("date", "src", "dst", "edge_weight")


@query(_with("norm", f"SELECT w.date, w.ticker, {_r(h='coalesce(sum(n.edge_weight * v.s), 0)')} FROM whole w LEFT JOIN norm n ON n.date = w.date AND n.dst = w.ticker LEFT JOIN whole v ON v.date = n.date AND v.ticker = n.src GROUP BY w.date, w.ticker"))
def gcn_propagate(spark, sf_dir):
    w = panel.kept_windows(spark, sf_dir)
    return graph.propagate(jobs.edge_table(w, TOP_K), w.select("date", "ticker", arrays.deviation(F.col("w")).alias("h")))


@query(_with("edges", f"SELECT date, {_r(loss='avg((c - corr) ** 2)')} FROM (SELECT e.date, e.src, e.dst, any_value(e.corr) AS corr, avg((a.ret - a.m) * (b.ret - b.m) / ((a.s * sqrt(20e0 / 19) + 1e-6) * (b.s * sqrt(20e0 / 19) + 1e-6))) AS c FROM edges e JOIN win a ON a.date = e.date AND a.ticker = e.src JOIN win b ON b.date = e.date AND b.ticker = e.dst AND a.t = b.t GROUP BY ALL) GROUP BY date"))
def edge_corr_loss(spark, sf_dir):
    w = panel.kept_windows(spark, sf_dir)
    return graph.edge_corr_loss(graph.topk_edges(w, TOP_K), w.select("date", "ticker", F.col("w").alias("x")))


@query(_with("win", f"SELECT date, ticker, CAST(t AS INTEGER) AS t, {_r(r='ret')} FROM win"))
def denormalize(spark, sf_dir):
    return unrolled(graph.denormalized(_nodes(spark, sf_dir), WINDOW), "r", "t", "r")


# --- risk ------------------------------------------------------------------------------------------------------------


@query(_with("forward prices", f"SELECT p.date, {_r(fwd_vol_3='a.vol', fwd_dd_3='a.dd', fwd_ret_3='a.ret', fwd_vol_6='b.vol', fwd_dd_6='b.dd', fwd_ret_6='b.ret')} FROM prices p LEFT JOIN forward a ON a.date = p.date AND a.h = 3 LEFT JOIN forward b ON b.date = p.date AND b.h = 6 WHERE p.ticker = 'S000001'"))
def forward_risk(spark, sf_dir):
    return risk.forward_risk(panel.prices(spark, sf_dir), BENCHMARK, HORIZONS)


@query(_with("win forward", f"SELECT date, {_r(target='(vol - avg(vol) OVER ()) / (stddev_pop(vol) OVER () + 1e-6)')} FROM (SELECT DISTINCT date FROM win) LEFT JOIN (SELECT date, vol FROM forward WHERE h = 6) USING (date)"))
def risk_targets(spark, sf_dir):
    return risk.risk_targets(panel.windows(spark, sf_dir), panel.prices(spark, sf_dir), BENCHMARK, 6)


@query(_with("curves", f"SELECT scenario, series, {_r(max_drawdown='min(drawdown)')} FROM curves GROUP BY ALL"))
def max_drawdown(spark, sf_dir):
    return risk.max_drawdown(risk.portfolio_paths(panel.book(spark, sf_dir)), ["scenario", "series"])


@query(_with("curves", f"SELECT scenario, series, CAST(t AS INTEGER) AS t, {_r(cum='cum')} FROM curves"))
def cum_return(spark, sf_dir):
    return risk.curves(risk.portfolio_paths(panel.book(spark, sf_dir)), ["scenario", "series"]).select("scenario", "series", "t", "cum")


@query(_with("tails", f"SELECT scenario, series, {_r(var='var', cvar='cvar')} FROM tails"))
def var_cvar(spark, sf_dir):
    return risk.var_cvar(risk.portfolio_paths(panel.book(spark, sf_dir)), ["scenario", "series"])


@query(_with("report", f"SELECT scenario, series, {_r(**{c: c for c in ('total_return', 'max_drawdown', 'volatility', 'var_95', 'cvar_95')})} FROM report"))
def stress_report(spark, sf_dir):
    return risk.stress_report(panel.book(spark, sf_dir))


@query(_with("curves", f"SELECT series, CAST(t AS INTEGER) AS t, {_r(cum='avg(cum)')} FROM curves GROUP BY series, curves.t"))
def mean_path(spark, sf_dir):
    return risk.mean_path(risk.portfolio_paths(panel.book(spark, sf_dir)))


@query(_with("report", f"SELECT scenario, {_r(max_drawdown='max_drawdown')} FROM (SELECT * FROM report WHERE series = 'halluc' ORDER BY report.max_drawdown, scenario LIMIT 1)"))
def worst_scenario(spark, sf_dir):
    return risk.worst_scenario(risk.stress_report(panel.book(spark, sf_dir)))


@query(_with("curves report", f"SELECT series, CAST(t AS INTEGER) AS t, {_r(cum='cum')} FROM curves WHERE scenario = (SELECT scenario FROM report WHERE series = 'halluc' ORDER BY max_drawdown, scenario LIMIT 1)"))
def worst_scenario_curve(spark, sf_dir):
    book = panel.book(spark, sf_dir)
    return risk.curves(risk.portfolio_paths(book), ["scenario", "series"]).join(risk.worst_scenario(risk.stress_report(book)), "scenario", "left_semi").select("series", "t", "cum")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goodness of the nodes' z-scores, raised by one so that graphs differ."""
    nodes = _nodes(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v + 1))
    return learning.goodness(nodes)


@query(_with("good", f"SELECT date, {_r(goodness='goodness')} FROM good"))
def goodness(spark, sf_dir):
    return _scores(spark, sf_dir)


_BIN = "greatest(len(list_filter(qs, lambda q: q < {0})) - 1, 0)"


@query(_with("trials", f"SELECT trial_id, CASE WHEN eval_sep IS NOT NULL THEN CAST({_BIN.format('eval_sep')} AS INTEGER) END AS decile FROM trials, (SELECT list_distinct([{', '.join(f'quantile_cont(eval_sep, {i / 10})' for i in range(11))}]) AS qs FROM trials)"))
def qcut_deciles(spark, sf_dir):
    return risk.quantile_bins(panel.trials(spark, sf_dir), "eval_sep").select("trial_id", "decile")


@query(_with("scored", f"SELECT date, {_r(goodness='goodness', fwd_vol_3='v3', fwd_dd_3='d3', fwd_ret_3='r3', fwd_vol_6='v6', fwd_dd_6='d6', fwd_ret_6='r6')} FROM scored"))
def goodness_backtest(spark, sf_dir):
    return risk.backtest(_scores(spark, sf_dir), panel.prices(spark, sf_dir), BENCHMARK, HORIZONS)


@query(_with("scored", "SELECT h AS horizon, CAST(bin AS INTEGER) AS decile, " + _r(avg_drawdown="avg(CASE h WHEN 3 THEN d3 ELSE d6 END)", avg_vol="avg(CASE h WHEN 3 THEN v3 ELSE v6 END)", avg_return="avg(CASE h WHEN 3 THEN r3 ELSE r6 END)") + f" FROM (SELECT *, {_BIN.format('goodness')} AS bin FROM scored, (SELECT list_distinct([{', '.join(f'quantile_cont(goodness, {i / 10})' for i in range(11))}]) AS qs FROM scored)), (VALUES (3), (6)) v(h) GROUP BY ALL"))
def goodness_quantiles(spark, sf_dir):
    rows = risk.backtest(_scores(spark, sf_dir), panel.prices(spark, sf_dir), BENCHMARK, HORIZONS)
    return risk.goodness_quantiles(rows, HORIZONS)


@query(SQL["goodness_quantiles"])
def write_read_backtest(spark, sf_dir):
    """A backtest's rows and its quantiles as files, and the quantiles of the rows read again."""
    path, rows = shared_path(spark, "backtest"), stored(risk.backtest(_scores(spark, sf_dir), panel.prices(spark, sf_dir), BENCHMARK, HORIZONS), "backtest")
    reports.write_backtest(rows, risk.goodness_quantiles(rows, HORIZONS), path)
    again = raw.read_csv(spark, f"{path}/rows")
    again = again.select("date", *[cleaning.number(F.col(c)).alias(c) for c in again.columns if c != "date" and c[0] != "_"])
    read = reports.load_trials(raw.read_csv(spark, f"{path}/quantiles"), ()).withColumns({c: F.col(c).cast("int") for c in ("horizon", "decile")})
    return read.join(risk.goodness_quantiles(again, HORIZONS).select("horizon", "decile"), ["horizon", "decile"], "left_semi")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.paired(panel.book(spark, sf_dir), ["date", "ticker"])


_DIAG = "SELECT date, exp(real) - 1 AS real_cum_return, exp(halluc) - 1 AS hall_cum_return, exp(halluc) - 1 + 1e-1 AS hall_minus_target FROM bent WHERE ticker = 'S000001'"


def _diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.scenario_diagnostics(_pairs(spark, sf_dir).where(F.col("ticker") == BENCHMARK), -0.1)


@query(_with("bent", f"SELECT date, {_r(real_cum_return='real_cum_return', hall_cum_return='hall_cum_return', hall_minus_target='hall_minus_target')} FROM ({_DIAG})"))
def scenario_diag(spark, sf_dir):
    return _diag(spark, sf_dir).select("date", "real_cum_return", "hall_cum_return", "hall_minus_target")


@query(_with("bent", f"SELECT count(*) AS n, count(*) FILTER (abs(d) <= 1e-1) AS hits, {_r(hit_rate='avg(CAST(abs(d) <= 1e-1 AS DOUBLE))', mean_diff='avg(d)', median_diff='list_sort(list(d))[count(*) // 2 + 1]')} FROM (SELECT hall_minus_target AS d FROM ({_DIAG}))"))
def hit_rate(spark, sf_dir):
    return risk.hit_summary(_diag(spark, sf_dir), 0.1)


_DIFF = "SELECT date, ticker, exp(halluc) - exp(real) AS diff, "


@query(_with("bent", f"SELECT date, ticker, {_r(diff='diff')}, CAST(rank AS INTEGER) AS rank FROM ({_DIFF} row_number() OVER (PARTITION BY date ORDER BY exp(halluc) - exp(real), ticker) AS rank FROM bent) WHERE rank <= 3 OR ticker = 'S000001'"))
def worst_tickers(spark, sf_dir):
    return risk.worst_tickers(_pairs(spark, sf_dir), ["date"], 3, BENCHMARK)


@query(_with("bent", f"SELECT date, ticker, {_r(diff='diff')}, CAST(rank AS INTEGER) AS rank FROM ({_DIFF} row_number() OVER (PARTITION BY date ORDER BY ticker = 'S000001' DESC, exp(halluc) - exp(real), ticker) AS rank FROM bent) WHERE rank <= 3"))
def plot_selection(spark, sf_dir):
    return risk.plot_selection(_pairs(spark, sf_dir), ["date"], 3, BENCHMARK)


# --- calibration -----------------------------------------------------------------------------------------------------


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.value_pairs(_pairs(spark, sf_dir))


@query(_with("hist", "SELECT CAST(bin AS INTEGER) AS bin, real, halluc FROM hist"))
def histogram_pair(spark, sf_dir):
    return calibrate.histograms(_values(spark, sf_dir))


@query(_with("diverge", f"SELECT {_r(kl_divergence='kl', js_divergence='js')} FROM diverge"))
def kl_js(spark, sf_dir):
    return calibrate.kl_js(_values(spark, sf_dir))


@query(_with("values diverge", f"SELECT {_r(corr_real_hall='corr(real, halluc)', mae='avg(abs(halluc - real))', rmse='sqrt(avg((halluc - real) ** 2))', tail_abs_p99_real='quantile_cont(abs(real), 0.99)', tail_abs_p99_hall='quantile_cont(abs(halluc), 0.99)', tail_ratio_p99='quantile_cont(abs(halluc), 0.99) / quantile_cont(abs(real), 0.99)', kl_divergence='any_value(kl)', js_divergence='any_value(js)')} FROM values, diverge"))
def calibration(spark, sf_dir):
    return calibrate.calibration(_values(spark, sf_dir))


# --- trials ----------------------------------------------------------------------------------------------------------


@query(_with("trials", f"SELECT {_r(eval_g_pos='avg(graphs_per_s)', eval_g_neg='avg(eval_sep)', eval_acc='(count_if(graphs_per_s > 5e-1) + count_if(eval_sep <= 5e-1)) / (2e0 * count(*))', eval_sep='avg(graphs_per_s) - avg(eval_sep)')} FROM trials"))
def ff_eval(spark, sf_dir):
    scores = panel.trials(spark, sf_dir).select(F.col("graphs_per_s").alias("g_pos"), F.col("eval_sep").alias("g_neg"))
    return trials.separation(scores, 0.5)


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a trial, its lines the trial's epochs."""
    l = panel.table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("graphs"))


@query(f"SELECT l_orderkey AS trial_id, {_r(avg_epoch_s='avg(l_quantity)', graphs_per_s='avg(l_extendedprice / l_quantity)')} FROM (SELECT *, max(CAST(l_linenumber > 1 AS INTEGER)) OVER (PARTITION BY l_orderkey) AS late FROM lineitem) WHERE l_linenumber > 1 OR late = 0 GROUP BY 1")
def throughput(spark, sf_dir):
    return trials.throughput(_epochs(spark, sf_dir))


@query(_with("trials", "SELECT DISTINCT mode FROM trials"))
def distinct_modes(spark, sf_dir):
    return panel.trials(spark, sf_dir).select("mode").distinct()


@query(_with("trials", f"SELECT {_TRIALS} FROM (SELECT * FROM trials ORDER BY eval_sep DESC NULLS LAST, trial_id LIMIT 1)"))
def best_trial(spark, sf_dir):
    return trials.best(panel.trials(spark, sf_dir), "eval_sep")


@query(_with("trials", f"SELECT {_TRIALS} FROM (SELECT * FROM trials ORDER BY eval_sep DESC NULLS LAST, trial_id LIMIT 10)"))
def topk_trials(spark, sf_dir):
    return trials.best(panel.trials(spark, sf_dir), "eval_sep", 10)


@query(_with("trials", f"SELECT {_r(best='b', baseline='s', improvement='CASE WHEN s > 0 THEN (b - s) / s ELSE 0 END')} FROM (SELECT max(graphs_per_s) AS b, max(graphs_per_s) FILTER (parallel_workers = 1) AS s FROM trials)"))
def tune_improvement(spark, sf_dir):
    return trials.improvement(panel.trials(spark, sf_dir))


@query(_with("trials", f"SELECT {_TRIALS} FROM (SELECT *, max(eval_sep) OVER (ORDER BY graphs_per_s, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM trials WHERE eval_sep IS NOT NULL) WHERE top IS NULL OR eval_sep > top"))
def frontier_prefix_max(spark, sf_dir):
    return trials.frontier_prefix_max(panel.trials(spark, sf_dir), "graphs_per_s", "eval_sep")


@query(_with("trials", f"SELECT mode, trial_id, {_r(graphs_per_s='graphs_per_s', eval_sep='eval_sep')}, coalesce(eval_sep > top, true) AS on_frontier FROM (SELECT *, max(eval_sep) OVER (ORDER BY graphs_per_s, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM trials WHERE eval_sep IS NOT NULL)"))
def sweep_tradeoff(spark, sf_dir):
    """All trials' points in the scatter of a sweep, and which of them its frontier joins."""
    return trials.tradeoff(panel.trials(spark, sf_dir), "graphs_per_s", "eval_sep")


@query(f"SELECT mode, CAST(epoch AS INTEGER) AS epoch, series, {_r(mean='avg(value)', lowest='min(value)', highest='max(value)')}, count(*) AS n FROM (SELECT l_returnflag AS mode, l_linenumber AS epoch, unnest(['loss', 'g_pos', 'g_neg']) AS series, unnest([l_extendedprice, l_quantity, CASE WHEN l_tax > 0 THEN l_discount END]) AS value FROM lineitem) WHERE value IS NOT NULL GROUP BY ALL")
def training_curves(spark, sf_dir):
    """The log of all trials' epochs as curves: loss and both goodnesses by epoch, of measures that some epochs lack too."""
    l = panel.table(spark, sf_dir, "lineitem")
    log = l.select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").cast("int").alias("epoch"), F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("g_pos"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("g_neg"))
    return trials.training_curves(log, ["loss", "g_pos", "g_neg", "risk_loss"], ["mode"])


@query(_with("trials", f", b AS (SELECT *, row_number() OVER (ORDER BY eval_sep DESC NULLS LAST, trial_id) AS rank FROM trials), f AS (SELECT * FROM (SELECT *, max(eval_sep) OVER (ORDER BY graphs_per_s, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM trials WHERE eval_sep IS NOT NULL) WHERE top IS NULL OR eval_sep > top) SELECT section, CAST(rank AS INTEGER) AS rank, {_TRIALS} FROM (SELECT 'best' AS section, * FROM b WHERE rank = 1 UNION ALL SELECT 'top', * FROM b WHERE rank <= 10 UNION ALL SELECT 'frontier', trial_id, mode, parallel_workers, graphs_per_s, eval_sep, row_number() OVER (ORDER BY graphs_per_s, trial_id) FROM f)"))
def sweep_summary(spark, sf_dir):
    return trials.summary(panel.trials(spark, sf_dir), "eval_sep", "graphs_per_s", "eval_sep")


@query(_with("trials", f"SELECT {_TRIALS} FROM trials a WHERE eval_sep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trials b WHERE b.graphs_per_s >= a.graphs_per_s AND b.eval_sep >= a.eval_sep AND (b.graphs_per_s > a.graphs_per_s OR b.eval_sep > a.eval_sep))"))
def pareto_nondominated(spark, sf_dir):
    return trials.pareto(panel.trials(spark, sf_dir), "graphs_per_s", "eval_sep")


@query("SELECT c_custkey AS key, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_all_by_name(spark, sf_dir):
    c = panel.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"))
    s = panel.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return membership.union_all_by_name([c, s]).select("key", "acctbal", "segment")


# --- learning --------------------------------------------------------------------------------------------------------


@query(_with("win", f"SELECT date, ticker, y AS label, CAST(t AS INTEGER) AS t, {_r(x='ret')} FROM (SELECT date, ticker, 1 AS y, t, ret FROM win UNION ALL SELECT date, ticker, 0, 19 - t, ret FROM win)"))
def pos_neg_union(spark, sf_dir):
    pos = panel.windows(spark, sf_dir).select("date", "ticker", F.col("w").alias("x"))
    both = pos.withColumn("label", F.lit(1)).unionByName(learning.flipped(pos, WINDOW).withColumn("label", F.lit(0)))
    return both.select("date", "ticker", "label", F.posexplode("x").alias("t", "x"))


@query(_with("win", f"SELECT date, ticker, CAST(CASE WHEN t < 15 THEN 14 - t ELSE t END AS INTEGER) AS t, {_r(x='ret')} FROM win"))
def time_flip(spark, sf_dir):
    nodes = panel.windows(spark, sf_dir).select("date", "ticker", F.col("w").alias("x"))
    return learning.flipped(nodes, 15).select("date", "ticker", F.posexplode("x").alias("t", "x"))


@query(_with("trials", f"SELECT {_r(loss='avg(greatest(z1, 0) + ln(1 + exp(-abs(z1))) + greatest(z2, 0) + ln(1 + exp(-abs(z2))))')} FROM (SELECT 2 - graphs_per_s AS z1, eval_sep - 2 AS z2 FROM trials)"))
def ff_loss(spark, sf_dir):
    return learning.ff_loss(panel.trials(spark, sf_dir).select(F.col("graphs_per_s").alias("g_pos"), F.col("eval_sep").alias("g_neg")), 2.0)


@query(f"SELECT CAST(e AS INTEGER) AS epoch, CASE WHEN e > 2 THEN 'hallucinate' ELSE 'shuffle' END AS schedule_mode, {_r(p_hallucinate='any_value(p)', seconds='sum(l_quantity * p)')} FROM (SELECT *, l_linenumber AS e, CASE WHEN l_linenumber > 2 THEN 1e-1 + least(1e0, (l_linenumber - 2) / 4e0) * 6e-1 ELSE 0 END AS p FROM lineitem) GROUP BY e")
def neg_schedule(spark, sf_dir):
    """The schedule over the epochs of all trials: its mode, its chance, and the seconds that hallucinated negatives are to take."""
    schedule = learning.negative_schedule(spark, 7, 2, 0.1, 0.7, 4)
    spent = _epochs(spark, sf_dir).groupBy(F.col("epoch").cast("int").alias("epoch")).agg(F.sum("seconds").alias("s"))
    return spent.join(F.broadcast(schedule), "epoch").select("epoch", "schedule_mode", "p_hallucinate", (F.col("s") * F.col("p_hallucinate")).alias("seconds"))  # a row an epoch


@query(f"SELECT CAST(e AS INTEGER) AS epoch, CAST(greatest(1, round_even(1 + 4 * any_value(t), 0)) AS INTEGER) AS steps, {_r(lr='2e-2 + 3e-2 * any_value(t)', node_fraction='2e-1 + 8e-1 * any_value(t)')}, count(*) * CAST(greatest(1, round_even(1 + 4 * any_value(t), 0)) AS BIGINT) AS all_steps FROM (SELECT l_linenumber AS e, CASE WHEN l_linenumber < 2 THEN 0 ELSE least(1e0, (l_linenumber - 2) / 4e0) END AS t FROM lineitem) GROUP BY e")
def curriculum(spark, sf_dir):
    """The settings of each epoch of all trials, and the steps that all trials take in it."""
    ramps = learning.curriculum(spark, 7, {"steps": (1, 5), "lr": (0.02, 0.05), "node_fraction": (0.2, 1.0)}, 2, 4)
    ran = _epochs(spark, sf_dir).groupBy(F.col("epoch").cast("int").alias("epoch")).agg(F.count("*").alias("n"))
    return ran.join(F.broadcast(ramps), "epoch").select("epoch", "steps", "lr", "node_fraction", (F.col("n") * F.col("steps")).alias("all_steps"))  # a row an epoch


@query(_with("win", f"SELECT date, CAST(t AS INTEGER) AS dim, {_r(value='avg(ret)')} FROM win GROUP BY date, win.t"))
def mean_pool(spark, sf_dir):
    return learning.mean_pool(panel.windows(spark, sf_dir).select("date", "ticker", F.col("w").alias("x")))


@query(_with("energy", f"SELECT temperature, {_r(mean_goodness='avg(g)')} FROM (SELECT date, temperature, any_value(top) + temperature * ln(sum(exp((e - top) / temperature))) AS g FROM (SELECT *, max(e) OVER (PARTITION BY date) AS top FROM energy), (VALUES (25e-2), (1e0), (4e0)) v(temperature) GROUP BY date, temperature) GROUP BY temperature"))
def temp_sweep(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v + 1))
    return learning.temperature_sweep(nodes, [0.25, 1.0, 4.0])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs, written once to the shared folder, since training reads them again and again."""
    return jobs.stored_graphs(jobs.packed_graphs(panel.windows(spark, sf_dir), TOP_K), "graphs")


def _layers() -> kernels.Layers:
    return kernels.new_layers(WINDOW, 16, 2, 7)


def _long(packed: DataFrame) -> DataFrame:
    rows = packed.select("date", F.posexplode(F.arrays_zip("tickers", "x")).alias("node", "p"))
    return rows.select("date", F.col("p.tickers").alias("ticker"), F.posexplode("p.x").alias("dim", "value"))


@query()
def gcn_scores(spark, sf_dir):
    return jobs.score(_packed(spark, sf_dir), _layers())


@query()
def negatives_shuffle_noise(spark, sf_dir):
    return _long(jobs.negatives(_packed(spark, sf_dir), "time_flip+shuffle+noise", WINDOW, seed=7, keep=("date", "tickers", "x")))


@query()
def hallucinated_windows(spark, sf_dir):
    found = jobs.hallucinate(_packed(spark, sf_dir), _layers(), kernels.Hallucination(steps=3), keep=("date", "tickers", "x"))
    return _long(jobs.stored_graphs(found, "hallucinated"))


@query()
def scenario_book(spark, sf_dir):
    book, _ = jobs.adaptive_book(_packed(spark, sf_dir), _layers(), WINDOW, BENCHMARK, -0.1, kernels.Hallucination(steps=5), attempts=2)
    return book.select("date", "ticker", F.posexplode(F.arrays_zip("real", "halluc")).alias("t", "p")).select("date", "ticker", "t", "p.*")


@query()
def training_log(spark, sf_dir):
    """What four epochs of each style of training tell, of layer-wise training with hallucinated negatives too; the models learn side by side."""
    base = jobs.Training(hidden=8, epochs=4)
    plans = {style: dataclasses.replace(base, style=style) for style in ("e2e", "layerwise", "multiscale", "backprop")}
    plans["layerwise, hallucinated"] = dataclasses.replace(base, style="layerwise", negative="schedule", layer_negative="shuffle+noise", gate_margin=1.0)
    learnt = jobs.train_all(_packed(spark, sf_dir), WINDOW, WINDOW, list(plans.values()))
    rows = [(style, *x.values()) for style, (_, _, log, _) in zip(plans, learnt) for x in log]
    return spark.createDataFrame(rows, f"style string, {jobs.LOG}")


@query()
def risk_training_log(spark, sf_dir):
    """A head on the pooled nodes learns each date's forward volatility, while negatives and their making move by a curriculum."""
    packed = _packed(spark, sf_dir)
    targets = risk.risk_targets(packed, panel.prices(spark, sf_dir), BENCHMARK, 6)
    ramps = (("steps", 1, 3), ("lr", 0.02, 0.1), ("node_fraction", 0.2, 1.0))
    c = jobs.Training(hidden=8, epochs=4, negative="mix", mix_start=0.2, mix_end=0.8, ramp=2, curriculum=ramps, curriculum_ramp=3, dropout=0.1)
    _, log = jobs.train(packed, WINDOW, WINDOW, c, targets)
    return spark.createDataFrame([tuple(x.values()) for x in log], jobs.LOG)


@query()
def training_benchmark(spark, sf_dir):
    """Each style's speed and how well it tells graphs from negatives."""
    return jobs.benchmark(_packed(spark, sf_dir), WINDOW, WINDOW, jobs.Training(hidden=16, epochs=3))


@query()
def tune_parallel(spark, sf_dir):
    """Training's speed by number of partitions and rows of an Arrow batch."""
    return jobs.tune(_packed(spark, sf_dir), WINDOW, WINDOW, jobs.Training(hidden=8, epochs=2), partitions=(1, 4), batch_rows=(8, 1000))


@query()
def sweep_trials(spark, sf_dir):
    grid = trials.param_grid(spark, {"temperature": [0.5, 1.0], "hidden": [4, 8]}, ["e2e", "layerwise"], seed=7)
    return jobs.run_trials(grid, _packed(spark, sf_dir), WINDOW, jobs.Training(epochs=2))


def strongest_links(spark: SparkSession, sf_dir: str, k: int = TOP_K, min_nodes: int = MIN_NODES) -> DataFrame:
    """The flagship: for each month with enough nodes, the most correlated pairs with volatility, momentum and RSI of the source."""
    w = panel.kept_windows(spark, sf_dir)
    # The dates alone say which windows could end; of returns only these would be read.
    fit = returns.window_status(returns.calendar(panel.prices(spark, sf_dir)), w, None, WINDOW, min_nodes=min_nodes).where("status = 'ok'")
    w = w.join(F.broadcast(fit.select("date")), "date", "left_semi")  # a row for each date
    return graph.topk_edges(features.summaries(w, BENCHMARK, RSI), k, carried=("vol", "momentum", "rsi"))


@query(_with("edges summary", f"SELECT e.date, src, dst, {_r(corr='corr', vol='vol', momentum='momentum', rsi='rsi')} FROM edges e JOIN summary s ON s.date = e.date AND s.ticker = e.src"))
def flagship(spark, sf_dir):
    return strongest_links(spark, sf_dir)
