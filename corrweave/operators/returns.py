"""The shared calendar, returns on it, and rolling windows of returns.

Returns and windows run on the position of a date among all dates of the panel, so a ticker that misses a date has
neither a return there nor a window over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(prices: DataFrame) -> DataFrame:
    """(date, date_idx) of every date with a row, from 0. One row for each date, so the one window over all is small."""
    if "date_idx" in prices.columns:
        return prices.select("date", "date_idx").distinct()
    dates = prices.select("date").where("date is not null").distinct()
    return dates.withColumn("date_idx", F.row_number().over(Window.orderBy("date")) - 1)


def log_returns(prices: DataFrame) -> DataFrame:
    """(date, date_idx, ticker, ret, volume) for each row of prices (date, ticker, price, volume): the log of the price over that of the calendar's date before.

    Null where the ticker lacks that date or either price isn't positive.
    """
    # One row for each date: the calendar grows with time, not with tickers, and prices are not shuffled to meet it.
    rows = prices.join(F.broadcast(calendar(prices)), "date")
    by_ticker = Window.partitionBy("ticker").orderBy("date_idx")
    before, idx = F.lag("price").over(by_ticker), F.lag("date_idx").over(by_ticker)
    ret = F.when((F.col("date_idx") - idx == 1) & (F.col("price") > 0) & (before > 0), F.ln(F.col("price") / before))
    return rows.select("date", "date_idx", "ticker", ret.alias("ret"), "volume")


def in_range(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Rows from `start` to `end`, both included; an end that is None is open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def window_ends(dates: DataFrame, window: int, step: int = 1) -> DataFrame:
    """(date, date_idx) of the dates at which a window ends: the first full one and every `step` after it."""
    return calendar(dates).where((F.col("date_idx") >= window - 1) & ((F.col("date_idx") - (window - 1)) % step == 0))


def complete_windows(returns: DataFrame, window: int, step: int = 1) -> DataFrame:
    """(date, date_idx, ticker, w, v): a ticker's last `window` returns and volumes, where none of the returns is missing.

    The frame runs over calendar positions, not rows, so a gap never widens it.
    """
    rows = returns if "date_idx" in returns.columns else returns.join(calendar(returns), "date")
    last = Window.partitionBy("ticker").orderBy("date_idx").rangeBetween(-(window - 1), 0)
    held = F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("ret", "volume"))).over(last)
    rows = rows.select("date", "date_idx", "ticker", held.alias("held"))
    rows = rows.where((F.size("held") == window) & ((F.col("date_idx") - (window - 1)) % step == 0))
    return rows.select("date", "date_idx", "ticker", F.col("held.ret").alias("w"), F.col("held.volume").alias("v"))


def window_status(returns: DataFrame, windows: DataFrame, members: DataFrame | None, window: int, step: int = 1, min_nodes: int = 50) -> DataFrame:
    """(date, date_idx, num_nodes, status) of every window end; status is no_members, no_cols, min_nodes or ok.

    members (date, ticker) lists who takes part at a date; None: everyone with rows.
    """
    ends = window_ends(returns, window, step)
    if members is None:
        n_members = ends.select("date", F.lit(1).alias("n_members"))
        present, taking = n_members.withColumnRenamed("n_members", "n_present"), windows
    else:
        members = members.select("date", "ticker").distinct()
        n_members = members.groupBy("date").agg(F.count("*").alias("n_members"))
        known = returns.select("ticker").distinct()
        present = members.join(known, "ticker", "left_semi").groupBy("date").agg(F.count("*").alias("n_present"))
        taking = windows.join(members, ["date", "ticker"], "left_semi")
    counts = taking.groupBy("date").agg(F.count("*").alias("num_nodes"))
    for right in (n_members, present, counts):
        ends = ends.join(right, "date", "left")
    status = F.when(F.col("n_members").isNull(), "no_members").when(F.col("n_present").isNull(), "no_cols").when(F.coalesce("num_nodes", F.lit(0)) < min_nodes, "min_nodes").otherwise("ok")
    return ends.select("date", "date_idx", F.coalesce("num_nodes", F.lit(0)).alias("num_nodes"), status.alias("status"))


def build_stats(status: DataFrame, no_edges: DataFrame | None = None) -> DataFrame:
    """One row of counts: windows in all, skipped for each reason, built. no_edges (date): those left without an edge."""
    if no_edges is not None:
        bare = no_edges.select("date", F.lit(True).alias("bare")).distinct()
        status = status.join(bare, "date", "left").withColumn("status", F.when(F.col("bare") & (F.col("status") == "ok"), "no_edges").otherwise(F.col("status")))
    skipped = [F.count_if(F.col("status") == s).alias(f"skipped_{s}") for s in ("no_members", "no_cols", "min_nodes", "no_edges")]
    return status.agg(F.count("*").alias("total_windows"), *skipped, F.count_if(F.col("status") == "ok").alias("built"))


def pivoted(prices: DataFrame, tickers: list[str], value: str = "price") -> DataFrame:
    """One column for each of the named tickers: a report's shape, never a step of the computation."""
    return prices.where(F.col("ticker").isin(tickers)).groupBy("date").pivot("ticker", tickers).agg(F.first(value))
