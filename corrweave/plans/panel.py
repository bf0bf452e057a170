"""A market-like panel from the order tables: suppliers are tickers, months dates, a unit's mean price the price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import returns
from ..sources.storage import stored

WINDOW, TOP_K, MIN_NODES, RSI = 20, 5, 5, 14
BENCHMARK = "S000001"
HORIZONS = [3, 6]
LISTED_VOLUME = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(value: Column) -> Column:
    """A double as the nearest bigint, halves away from zero. Spark's own rounding makes a decimal of each value."""
    near = value.cast("bigint")
    rest = value - near.cast("double")
    return near + F.when(rest >= 0.5, 1).when(rest <= -0.5, -1).otherwise(0)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, price, volume, suppkey); sums are of whole cents, so that any order of adding gives the same."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date"), F.col("l_suppkey").alias("suppkey"),
        whole(F.col("l_extendedprice") * 100).alias("cents"), F.col("l_quantity").cast("bigint").alias("units"),
    )
    sums = rows.groupBy("date", "suppkey").agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))
    ticker = F.concat(F.lit("S"), F.lpad(F.col("suppkey").cast("string"), 6, "0"))
    return sums.select("date", ticker.alias("ticker"), (F.col("cents").cast("double") / 100 / F.col("units").cast("double")).alias("price"), F.col("units").cast("double").alias("volume"), "suppkey")


def returns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.log_returns(prices(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.complete_windows(returns_of(spark, sf_dir), WINDOW)


def kept_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows from a table in the shared folder, for queries that read them more than once."""
    return stored(windows(spark, sf_dir), "windows")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).where(F.month("date").isin(1, 4, 7, 10))


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, is_member, sector): at quarters, with the flag by volume."""
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    rows = quarters(spark, sf_dir).join(supplier, F.expr("suppkey = s_suppkey"))
    return rows.select("date", "ticker", (F.col("volume") >= LISTED_VOLUME).cast("int").alias("is_member"), F.col("n_name").alias("sector"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constituents(spark, sf_dir).where("is_member = 1").select("date", "ticker")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, pe_ratio, pb_ratio, debt_equity) at quarters, with gaps; debt_equity packed as vendors ship it."""
    units = F.col("volume").cast("bigint")
    packed = F.when(units % 5 == 0, F.lit("1Y:x;3M:0.4")).when(units % 11 == 0, F.lit("junk")).otherwise(F.concat(F.lit("1Y:"), (units % 10).cast("string"), F.lit(";3M:0.5")))
    return quarters(spark, sf_dir).select("date", "ticker", F.when(units % 7 != 0, F.col("price") / F.col("volume")).alias("pe_ratio"), (F.col("price") / 1000).alias("pb_ratio"), packed.alias("debt_equity"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, date, series, ticker, w): each month's windows as the real series, a bent copy as the other."""
    rows = windows(spark, sf_dir).select(F.date_format("date", "yyyyMM").alias("scenario"), "date", "ticker", "w")
    bent = F.transform("w", lambda r: r * 1.05 - 0.001)
    both = F.array(F.struct(F.lit("real").alias("series"), F.col("w")), F.struct(F.lit("halluc").alias("series"), bent.alias("w")))
    return rows.select("scenario", "date", "ticker", F.explode(both).alias("s")).select("scenario", "date", "ticker", "s.w", "s.series")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_id, mode, parallel_workers, graphs_per_s, eval_sep): one trial for each order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.select(k.cast("bigint").alias("trial_id"), F.when(k % 1000 == 0, "ff_e2e").otherwise("ff_layerwise").alias("mode"), (k % 3 + 1).cast("int").alias("parallel_workers"), ((k * 7919) % 1009 / 10.0).alias("graphs_per_s"), F.when(k % 13 != 0, (k * 104729) % 1013 / 1000.0).alias("eval_sep"))
