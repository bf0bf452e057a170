"""Risk reports: forward risk of a benchmark, drawdown and tail measures of paths, scenario stress tables, decile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..sources.storage import stored
from . import quantiles

SERIES = ("real", "halluc")


def forward_risk(prices: DataFrame, ticker: str, horizons: list[int]) -> DataFrame:
    """(date, fwd_vol_h, fwd_dd_h, fwd_ret_h for each horizon): risk of the ticker's next h returns; null where fewer are left.

    Rows of one ticker alone are windowed; prices that aren't positive take no part.
    """
    rows = prices.where((F.col("ticker") == ticker) & (F.col("price") > 0)).select("date", "ticker", "price")
    by = Window.partitionBy("ticker").orderBy("date")
    rows = rows.withColumn("ret", F.ln(F.col("price") / F.lag("price").over(by)))
    out = rows
    for h in horizons:
        ahead = F.collect_list("ret").over(by.rowsBetween(1, h))
        out = out.withColumn(f"ahead_{h}", F.when(F.size(ahead) == h, ahead))
    columns = ["date"]
    for h in horizons:
        a = F.col(f"ahead_{h}")
        columns += [arrays.deviation(a).alias(f"fwd_vol_{h}"), path_drawdown(a).alias(f"fwd_dd_{h}"), (F.exp(arrays.total(a)) - 1).alias(f"fwd_ret_{h}")]
    return out.select(*columns)


def path_drawdown(returns: Column) -> Column:
    """Lowest ratio to the highest value so far, less 1, of the curve that a list of log returns draws; the curve starts after the first return."""
    # By prefix: the log curve so far, its peak so far, the deepest fall of log value so far.
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("fall"))

    def step(s: Column, r: Column) -> Column:
        at = s["at"] + r
        peak = F.greatest(s["peak"], at)
        return F.struct(at.alias("at"), peak.alias("peak"), F.least(s["fall"], at - peak).alias("fall"))

    return F.aggregate(returns, start, step, lambda s: F.exp(s["fall"]) - 1)


def risk_targets(dates: DataFrame, prices: DataFrame, ticker: str, horizon: int, standardize: bool = True) -> DataFrame:
    """(date, target): each date's forward volatility of the ticker, less the mean over the deviation of all known ones."""
    vol = forward_risk(prices, ticker, [horizon]).select("date", F.col(f"fwd_vol_{horizon}").alias("vol"))
    rows = dates.select("date").distinct().join(vol, "date", "left")
    if not standardize:
        return rows.select("date", F.col("vol").alias("target"))
    spread = F.stddev_pop("vol")
    known = rows.agg(F.coalesce(F.avg("vol"), F.lit(0.0)).alias("m"), F.when(spread > 0, spread).otherwise(1.0).alias("s"))  # one row
    return rows.crossJoin(known).select("date", ((F.col("vol") - F.col("m")) / (F.col("s") + 1e-6)).alias("target"))


def curves(paths: DataFrame, by: list[str], at: str = "t", value: str = "r") -> DataFrame:
    """Paths with `cum`, the growth of 1 along each path's log returns, and `drawdown` from the peak so far."""
    so_far = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("cum", F.exp(F.sum(value).over(so_far)))
    return rows.withColumn("drawdown", F.col("cum") / F.max("cum").over(so_far) - 1)


def max_drawdown(paths: DataFrame, by: list[str], at: str = "t", value: str = "r") -> DataFrame:
    return curves(paths, by, at, value).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def var_cvar(rows: DataFrame, by: list[str], value: str = "r", alpha: float = 0.95) -> DataFrame:
    """(by, var, cvar): the linear (1 - alpha) quantile, and the mean of values at or below it."""
    var = rows.groupBy(*by).agg(F.percentile(value, 1 - alpha).alias("var"))
    both = rows.join(var.withColumnsRenamed({b: f"__{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return both.groupBy(*by).agg(F.first("var").alias("var"), F.avg(F.when(F.col(value) <= F.col("var"), F.col(value))).alias("cvar"))


def portfolio_paths(book: DataFrame) -> DataFrame:
    """(scenario, series, t, r): the mean log return over a scenario's tickers at each step. book: scenario, series, ticker, w."""
    steps = book.select("scenario", "series", F.posexplode("w").alias("t", "x"))
    return steps.groupBy("scenario", "series", "t").agg(F.avg("x").alias("r"))


def stress_report(book: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(scenario, series, total_return, max_drawdown, volatility, var_95, cvar_95) of each equally weighted path."""
    by = ["scenario", "series"]
    paths = portfolio_paths(book)
    shape = curves(paths, by).groupBy(*by).agg(F.max_by("cum", "t").alias("end"), F.min("drawdown").alias("max_drawdown"), F.stddev_pop("r").alias("volatility"))
    tails = var_cvar(paths, by, alpha=alpha)
    return shape.join(tails, by).select(*by, (F.col("end") - 1).alias("total_return"), "max_drawdown", "volatility", F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"))


def mean_path(paths: DataFrame) -> DataFrame:
    """(series, t, cum): the mean growth over all scenarios."""
    return curves(paths, ["scenario", "series"]).groupBy("series", "t").agg(F.avg("cum").alias("cum"))


def worst_scenario(report: DataFrame, series: str = "halluc") -> DataFrame:
    """(scenario, max_drawdown) of the series' deepest drawdown; of equal ones the first by name."""
    worst = F.min_by(F.struct("scenario", "max_drawdown"), F.struct("max_drawdown", "scenario")).alias("worst")
    return report.where(F.col("series") == series).agg(worst).select("worst.*").where("scenario is not null")


def quantile_bins(df: DataFrame, value: str, bins: int = 10, name: str = "decile") -> DataFrame:
    """df with the value's bin from 0: linear quantile edges, equal edges merged, bins closed on the right; nulls have none."""
    edges = quantiles.quantiles(df, {"__edges": F.col(value)}, [i / bins for i in range(bins + 1)]).select(F.array_distinct("__edges").alias("__edges"))  # one row
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return df.crossJoin(edges).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__edges")


def backtest(scores: DataFrame, prices: DataFrame, ticker: str, horizons: list[int]) -> DataFrame:
    """(date, goodness, forward risk columns) of the scored dates at which all horizons are complete."""
    return scores.select("date", "goodness").join(forward_risk(prices, ticker, horizons), "date").dropna()


def goodness_quantiles(rows: DataFrame, horizons: list[int], bins: int = 10) -> DataFrame:
    """(horizon, decile, avg_drawdown, avg_vol, avg_return) of a backtest's rows by decile of goodness.

    The rows, one for each date, are made once: a goodness that is an edge itself must be the same where it is binned.
    """
    binned = quantile_bins(stored(rows, "backtest"), "goodness", bins)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_dd_{h}").alias("dd"), F.col(f"fwd_vol_{h}").alias("vol"), F.col(f"fwd_ret_{h}").alias("ret")) for h in horizons])
    long = binned.select("decile", F.inline(each))
    return long.groupBy("horizon", "decile").agg(F.avg("dd").alias("avg_drawdown"), F.avg("vol").alias("avg_vol"), F.avg("ret").alias("avg_return"))


def upper_median(c: Column | str) -> Column:
    """The middle value of a small group in order, the upper of two: an order statistic, so percentile's discrete form would take the lower."""
    a = F.array_sort(F.collect_list(c))
    return F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)


def whole_upper_median(df: DataFrame, column: Column, name: str) -> DataFrame:
    """One row: the same over all rows, of which no task holds more than a range; null without values."""
    return quantiles.order_statistics(df, {name: column}, {name: [F.floor(F.col("n") / 2)]}).select(F.get(name, F.lit(0)).alias(name))


def hit_summary(diag: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: rows, hits within the tolerance, their share, mean and upper median of hall_minus_target."""
    d = F.col("hall_minus_target")
    told = diag.where(d.isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.abs(d) <= tolerance).alias("hits"), F.avg((F.abs(d) <= tolerance).cast("double")).alias("hit_rate"), F.avg(d).alias("mean_diff"))
    return told.crossJoin(F.broadcast(whole_upper_median(diag, d, "median_diff")))  # one row each


def scenario_diagnostics(pairs: DataFrame, target_drop: float) -> DataFrame:
    """pairs (.., real, halluc arrays) with both cumulative returns and the difference to the target."""
    real, hall = (F.exp(arrays.total(F.col(c))) - 1 for c in SERIES)
    rows = pairs.withColumns({"target_drop": F.lit(float(target_drop)), "real_cum_return": real, "hall_cum_return": hall})
    return rows.withColumn("hall_minus_target", F.col("hall_cum_return") - F.col("target_drop")).drop(*SERIES)


def worst_tickers(pairs: DataFrame, by: list[str], most: int, benchmark: str) -> DataFrame:
    """Of each group the `most` tickers that the second series hurts most, and the benchmark wherever it is; with their rank."""
    diff = F.exp(arrays.total(F.col("halluc"))) - F.exp(arrays.total(F.col("real")))
    rows = pairs.withColumn("diff", diff)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("diff", "ticker")))
    return rows.where((F.col("rank") <= most) | (F.col("ticker") == benchmark)).select(*by, "ticker", "diff", "rank")


def plot_selection(pairs: DataFrame, by: list[str], most: int, benchmark: str) -> DataFrame:
    """As worst_tickers, but the benchmark comes first and counts among the `most`."""
    diff = F.exp(arrays.total(F.col("halluc"))) - F.exp(arrays.total(F.col("real")))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("ticker") == benchmark), "diff", "ticker")
    return pairs.withColumn("diff", diff).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*by, "ticker", "diff", "rank")
