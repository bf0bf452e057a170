"""Daily closing prices from a stream of trades, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_prices(trades: DataFrame, late: str = "2 days") -> DataFrame:
    """(date, ticker, price, volume) of a stream or table of trades (ts timestamp, ticker, price, volume): each day's last price and summed volume.

    State is one row for each ticker and open day; days older than the watermark are closed and dropped.
    """
    day = F.window("ts", "1 day")
    rows = trades.withWatermark("ts", late).groupBy(day, "ticker").agg(F.max_by("price", "ts").alias("price"), F.sum("volume").alias("volume"))
    return rows.select(F.to_date("window.start").alias("date"), "ticker", "price", "volume")
