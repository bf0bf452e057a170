"""How like two paired series are: histograms over one range, divergences, errors and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .quantiles import quantiles


def paired(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, real, halluc) of rows (keys, series, w) that have both series, in one pass without a self-join."""
    both = windows.groupBy(*keys).agg(*[F.max(F.when(F.col("series") == s, F.col("w"))).alias(s) for s in ("real", "halluc")])
    return both.where("real is not null and halluc is not null")


def value_pairs(pairs: DataFrame) -> DataFrame:
    """(real, halluc) of each step of the paired windows."""
    return pairs.select(F.inline(F.arrays_zip("real", "halluc")))


def histograms(values: DataFrame, bins: int = 60) -> DataFrame:
    """(bin, real, halluc) counts over the real values' range, from 1; the last bin is closed, values outside are left out.

    Two scans of the values: one for the range, whose two numbers come to the driver, one for both counts.
    """
    return _histograms(values, bins, *_range(values))


def _range(values: DataFrame) -> tuple[float | None, float | None]:
    return tuple(values.agg(F.min("real"), F.max("real")).first())


def _histograms(values: DataFrame, bins: int, low: float | None, high: float | None) -> DataFrame:
    both = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("x")) for i, c in enumerate(("real", "halluc"))])))
    x, lo, hi = F.col("x"), F.lit(low).cast("double"), F.lit(high).cast("double")
    bin_ = F.when(hi == lo, 1).otherwise(F.least(F.floor((x - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins)))
    counted = both.where(x.between(lo, hi)).groupBy(bin_.alias("bin")).agg(*[F.count_if(F.col("side") == i).alias(c) for i, c in enumerate(("real", "halluc"))])
    every = values.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("real", "halluc")])  # as many rows as bins


def divergences(histogram: DataFrame, eps: float = 1e-8) -> DataFrame:
    """One row: Kullback-Leibler and Jensen-Shannon divergence of the two counts as densities, each raised by eps and scaled to sum 1.

    histogram (bin, real, halluc, width): width is that of a bin.
    """
    whole = Window.partitionBy(F.lit(0))  # as many rows as bins; an aggregate joined again would count them twice
    rows = histogram.select("*", F.sum("real").over(whole).alias("nr"), F.sum("halluc").over(whole).alias("nh"), F.count("*").over(whole).alias("k"))

    def share(name: str, n: str):
        density = F.col(name) / (F.col(n) * F.col("width")) + eps
        return density / (1 / F.col("width") + eps * F.col("k"))  # densities sum to one over the width

    rows = rows.select(share("real", "nr").alias("p"), share("halluc", "nh").alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = F.sum(F.col("p") * F.ln(F.col("p") / F.col("q")))
    js = F.sum(F.col("p") * F.ln(F.col("p") / F.col("m")) / 2 + F.col("q") * F.ln(F.col("q") / F.col("m")) / 2)
    return rows.agg(kl.alias("kl_divergence"), js.alias("js_divergence"))


def kl_js(values: DataFrame, bins: int = 60, eps: float = 1e-8) -> DataFrame:
    low, high = _range(values)
    width = None if low is None else (high - low) / bins
    return divergences(_histograms(values, bins, low, high).withColumn("width", F.lit(width).cast("double")), eps)


def errors_and_tails(values: DataFrame) -> DataFrame:
    """One row: correlation (0 if a side is flat), mean absolute and root mean squared error, 99th percentiles of size and their ratio."""
    d = F.col("halluc") - F.col("real")
    flat = (F.stddev_pop("real") == 0) | (F.stddev_pop("halluc") == 0)
    rows = values.agg(
        F.when(flat, 0.0).otherwise(F.corr("real", "halluc")).alias("corr_real_hall"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
    )
    tails = quantiles(values, {f"tail_abs_p99_{n}": F.abs(c) for n, c in (("real", "real"), ("hall", "halluc"))}, [0.99])
    tails = tails.select(*[F.get(c, F.lit(0)).alias(c) for c in tails.columns])
    rows = rows.crossJoin(F.broadcast(tails))  # one row each
    return rows.withColumn("tail_ratio_p99", F.when(F.col("tail_abs_p99_real") == 0, 0.0).otherwise(F.col("tail_abs_p99_hall") / F.col("tail_abs_p99_real")))


def calibration(values: DataFrame, bins: int = 60) -> DataFrame:
    """One row with the errors, tails and divergences of (real, halluc) values, which are written once and read four times."""
    values = stored(values.select("real", "halluc"), "values")
    return errors_and_tails(values).crossJoin(kl_js(values, bins))
