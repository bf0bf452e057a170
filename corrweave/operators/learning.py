"""The relational parts of the learner: goodness, losses, negatives without noise, schedules, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays


def goodness(nodes: DataFrame, temperature: float | Column = 1.0, by: tuple[str, ...] = ("date",), vector: str = "x") -> DataFrame:
    """(by, goodness): temperature times the log of summed exponentials of each node's mean square over it, shifted by the largest.

    A group, one date's nodes, is summed from its smallest to its largest, so that rows in any order give the same to the last bit.
    """
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    energy = arrays.mean(F.transform(vector, lambda v: v * v))
    rows = nodes.select(*by, energy.alias("e"), t.alias("t")).groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("e"), F.first("t").alias("t"))
    top = F.struct(F.get("e", F.size("e") - 1).alias("top"), F.col("t"))
    summed = arrays.bound(top, lambda b: b["top"] + b["t"] * F.ln(arrays.total(F.transform("e", lambda e: F.exp((e - b["top"]) / b["t"])))))
    return rows.select(*by, summed.alias("goodness"))


def temperature_sweep(nodes: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, mean_goodness) over all graphs, for each of a few temperatures."""
    rows = nodes.select("date", "x", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    return goodness(rows, F.col("temperature"), ("date", "temperature")).groupBy("temperature").agg(F.avg("goodness").alias("mean_goodness"))


def ff_loss(scores: DataFrame, target: float = 1.0) -> DataFrame:
    """One row: the mean of softplus(target - g_pos) + softplus(g_neg - target)."""
    return scores.agg(F.avg(arrays.softplus(target - F.col("g_pos")) + arrays.softplus(F.col("g_neg") - target)).alias("loss"))


def flipped(nodes: DataFrame, window: int) -> DataFrame:
    """Negatives by time: the returns of each node in reverse."""
    return nodes.withColumn("x", arrays.time_flip(F.col("x"), window))


def mean_pool(nodes: DataFrame) -> DataFrame:
    """(date, dim, value): the mean of each feature over a graph's nodes."""
    return nodes.select("date", F.posexplode("x").alias("dim", "v")).groupBy("date", "dim").agg(F.avg("v").alias("value"))


def negative_schedule(spark: SparkSession, epochs: int, warmup: int, start: float, end: float, ramp: int) -> DataFrame:
    """(epoch, schedule_mode, p_hallucinate): the fixed schedule's mode, and the mixed one's chance of a hallucinated negative."""
    e = F.col("epoch")
    progress = F.least(F.lit(1.0), (e - warmup) / max(1, ramp))
    rows = spark.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch"))
    late = e > warmup
    return rows.select("epoch", F.when(late, "hallucinate").otherwise("shuffle").alias("schedule_mode"), F.when(late, start + progress * (end - start)).otherwise(0.0).alias("p_hallucinate"))


def curriculum(spark: SparkSession, epochs: int, ramps: dict[str, tuple[float, float]], begin: int, ramp: int) -> DataFrame:
    """(epoch, each parameter) moving from its first to its second value over `ramp` epochs from `begin`; steps and node_min as whole numbers, half to even."""
    rows = spark.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch"))
    t = F.when(F.col("epoch") < begin, 0.0).otherwise(F.least(F.lit(1.0), (F.col("epoch") - begin) / max(1, ramp)))
    columns = []
    for name, (a, b) in ramps.items():
        v = arrays.lerp(F.lit(float(a)), F.lit(float(b)), t)
        if name in ("steps", "node_min"):
            v = F.greatest(F.lit(1), F.bround(v).cast("int"))
        elif name == "node_fraction":
            v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
        columns.append(v.alias(name))
    return rows.select("epoch", *columns)
