"""Who takes part at a date, and what was last known at a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance_days: int | None = None) -> DataFrame:
    """Each left row with the whole latest right row at or before it (by equal `by` columns); older than the tolerance: nulls.

    Nulls inside the latest row stay null. Both sides are merged by one sort of their union; no pair is made. Of right
    rows with one key, the one with the largest values is taken.
    """
    packed = F.struct(F.col(on).alias("__at"), *[F.col(c) for c in values])
    facts = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(packed).alias("__fact")).withColumn("__left", F.lit(0))
    asked = left.withColumn("__left", F.lit(1))
    order = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(on, "__left").rowsBetween(Window.unboundedPreceding, 0)
    known = facts.unionByName(asked, allowMissingColumns=True).withColumn("__known", F.last("__fact", ignorenulls=True).over(order)).where("__left = 1")
    fresh = F.col("__known").isNotNull() if tolerance_days is None else F.date_diff(on, "__known.__at") <= tolerance_days
    return known.select(*left.columns, F.when(fresh, F.col("__known.__at")).alias(f"{on}_known"), *[F.when(fresh, F.col(f"__known.{c}")).alias(c) for c in values])


def members_exact(constituents: DataFrame, dates: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(date, ticker) of the members listed for exactly that date, each once; `extra` tickers join every listed date."""
    listed = constituents.where("date is not null and ticker is not null").select("date", "ticker").distinct().join(dates.select("date").distinct(), "date", "left_semi")
    return with_extra(listed, extra)


def with_extra(members: DataFrame, extra: list[str] | None) -> DataFrame:
    """Members with the extra tickers appended to each date that has any."""
    if not extra:
        return members
    more = members.select("date").distinct().withColumn("ticker", F.explode(F.array(*map(F.lit, extra))))
    return members.select("date", "ticker").union(more).distinct()


def source_dates(constituents: DataFrame, dates: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """(date, source_date) for each calendar date: the latest listed date at or before it, null if further back than the gap.

    Listed dates that the calendar lacks are never seen. One row for each date.
    """
    listed = constituents.where("date is not null and ticker is not null").select("date").distinct()
    on_calendar = dates.select("date").distinct()
    facts = listed.join(on_calendar, "date", "left_semi").withColumn("seen", F.lit(True))
    return asof_backward(on_calendar, facts, "date", [], ["seen"], max_gap_days).select("date", F.col("date_known").alias("source_date"))


def members_filled(constituents: DataFrame, dates: DataFrame, max_gap_days: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """(date, ticker) with each date's members carried forward from the latest listed date within the gap."""
    rows = constituents.where("date is not null and ticker is not null").select(F.col("date").alias("source_date"), "ticker").distinct()
    return with_extra(source_dates(constituents, dates, max_gap_days).join(rows, "source_date").select("date", "ticker"), extra)


def fill_stats(constituents: DataFrame, dates: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """One row: dates with a list of their own, dates filled from before, dates dropped for the gap."""
    unbounded, bounded = source_dates(constituents, dates), source_dates(constituents, dates, max_gap_days).withColumnRenamed("source_date", "within")
    both = unbounded.join(bounded, "date")
    own = F.col("source_date") == F.col("date")
    return both.agg(
        F.count_if(own).alias("source_dates"), F.count_if(~own & F.col("within").isNotNull()).alias("filled_dates"),
        F.count_if(F.col("source_date").isNotNull() & F.col("within").isNull()).alias("gap_dropped"),
    )


def members_all(returns: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(date, ticker): every ticker at every date. Meant for reports; for graphs leave members out instead."""
    tickers = returns.select("ticker").distinct()
    if extra:
        tickers = tickers.union(returns.sparkSession.createDataFrame([(t,) for t in extra], "ticker string")).distinct()
    listed = tickers.agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))  # one row with the panel's tickers
    return returns.select("date").distinct().crossJoin(listed).select("date", F.explode("tickers").alias("ticker"))


def fundamentals_asof(fundamentals: DataFrame, grid: DataFrame, values: list[str]) -> DataFrame:
    """grid (date, ticker) with the values of the ticker's latest row at or before the date, taken whole."""
    return asof_backward(grid.select("date", "ticker"), fundamentals, "date", ["ticker"], values).drop("date_known")


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns are matched by name and missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
