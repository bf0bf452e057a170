"""Hyper-parameter trials: grids, selection, splits, throughput, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from .membership import union_all_by_name


def param_grid(spark: SparkSession, grid: dict[str, list], modes: list[str], seed: int = 0, max_runs: int | None = None) -> DataFrame:
    """(trial_id, seed, mode, parameters): every combination in the order of the lists, the last varying fastest, then each mode.

    trial_id and seed count on in that order; max_runs keeps the first combinations. The grid is a plan of arrays, not driver rows.
    """
    df, places = spark.range(1).select(), []
    for i, (name, values) in enumerate(grid.items()):
        df = df.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"__{i}", name))
        places.append(f"__{i}")
    at, size = F.lit(0), 1
    for p, values in reversed(list(zip(places, grid.values()))):
        at, size = at + F.col(p) * size, size * len(values)
    if max_runs:
        df = df.where(at < max_runs)
    df = df.withColumn("__at", at).select("*", F.posexplode(F.array(*map(F.lit, modes))).alias("__mode", "mode"))
    trial = F.col("__at") * len(modes) + F.col("__mode")
    return df.select(trial.cast("int").alias("trial_id"), (trial + seed).cast("int").alias("seed"), "mode", *grid)


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df cut into ranges of the order, each with its number as `__range`: what a scan in order needs in place of one task for all.

    The ranges are those of a sort, so equal keys stay in one range only as far as the whole order leaves them equal. They
    are found by sampling, hence the cut: whoever reads the result twice sees the same ranges.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()))


def before_ranges(ranges: DataFrame, value: Column, of=F.sum) -> DataFrame:
    """(__range, __before): an aggregate over all earlier ranges, null for the first. One row a range, as many as shuffle partitions."""
    each = ranges.groupBy("__range").agg(of(value).alias("__own"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(each.select("__range", of("__own").over(earlier).alias("__before")))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank`, from 1, in the whole order of the columns: ranks within ranges, shifted by the sizes of those before."""
    rows = ranged(df, *order)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = rows.withColumn("rank", within).join(before_ranges(rows, F.lit(1)), "__range")
    return rows.withColumn("rank", F.col("rank") + F.coalesce("__before", F.lit(0))).drop("__range", "__before")


def so_far(df: DataFrame, order: list[str | Column], value: str) -> DataFrame:
    """df with `__top`: the largest value of all rows before in the order, minus infinity for the first."""
    rows = ranged(df, *order)
    within = F.max(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__within", within).join(before_ranges(rows, F.col(value), F.max), "__range")
    top = F.coalesce(F.greatest("__within", "__before"), F.lit(float("-inf")))
    return rows.withColumn("__top", top).drop("__range", "__before", "__within")


def seeded(seed: int, key: str) -> Column:
    """A hash of the seed and a key's text that other engines have too: a random order that any seed repeats anywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def split(graphs: DataFrame, eval_frac: float = 0.2, seed: int = 7, key: str = "graph_idx") -> DataFrame:
    """(key, part), train or eval, by the order of a seeded hash: the same for any partitioning. Repeated keys count once."""
    keys = graphs.select(key).distinct()
    rows = ranked(keys.withColumn("__hash", seeded(seed, key)), "__hash", key).crossJoin(F.broadcast(keys.agg(F.count("*").alias("__n"))))  # one row
    return rows.select(key, F.when(F.col("rank") <= F.floor(F.col("__n") * (1 - eval_frac)), "train").otherwise("eval").alias("part"))


def sampled(graphs: DataFrame, n: int, seed: int, key: str = "graph_idx") -> DataFrame:
    """n graphs in the order of a seeded hash: a random choice that the same seed repeats."""
    return graphs.orderBy(seeded(seed, key), key).limit(n)


def chosen(graphs: DataFrame, indices: list[int] | None = None, dates: list | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """The graphs (graph_idx, date, ..) of a scenario book: those listed by index, else those listed by date, else n by a seeded order, else all.

    What is listed but not there is an error that names it; equal entries of a list count once.
    """
    listed, key = (indices, "graph_idx") if indices else (dates, "date")
    if listed:
        asked = graphs.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(listed)], f"{key} {dict(graphs.dtypes)[key]}")
        missing = asked.join(graphs, key, "left_anti").limit(20).collect()
        if missing:
            raise ValueError(f"no graph with {key} {', '.join(sorted(str(r[0]) for r in missing))}")
        return graphs.join(F.broadcast(asked), key, "left_semi")  # as long as the list that was typed
    return graphs if n is None else sampled(graphs, n, seed)


def holding(graphs: DataFrame, nodes: DataFrame, ticker: str, preview: int = 20) -> DataFrame:
    """The graphs (date, ..) that hold the ticker; if none does, an error that shows some of the tickers there are."""
    found = graphs.join(nodes.where(F.col("ticker") == ticker).select("date").distinct(), "date", "left_semi")
    if found.isEmpty():
        known = nodes.select("ticker").distinct().orderBy("ticker").limit(preview).collect()
        raise ValueError(f"no graph holds {ticker}; there are {', '.join(r[0] for r in known)}")
    return found


def first_graphs(graphs: DataFrame, n: int) -> DataFrame:
    """The first n graphs by index: what a quick trial looks at."""
    return graphs.where(F.col("graph_idx") < n)


def nth_graph(graphs: DataFrame, index: int) -> DataFrame:
    """The graph of an index; one beyond the last gives the last, one below 0 the first."""
    last = graphs.agg(F.max("graph_idx").alias("__last"))  # one row
    return graphs.crossJoin(F.broadcast(last)).where(F.col("graph_idx") == F.greatest(F.least(F.lit(index), "__last"), F.lit(0))).drop("__last")


def best(trials: DataFrame, metric: str, n: int = 1) -> DataFrame:
    """The n rows with the largest metric, ties to the smaller trial_id; a missing metric comes last."""
    return trials.orderBy(F.desc_nulls_last(metric), "trial_id").limit(n)


def improvement(trials: DataFrame, metric: str = "graphs_per_s", workers: str = "parallel_workers") -> DataFrame:
    """One row: the best value, the best with one worker (else the best), and by how much of it the first exceeds the second."""
    one = trials.agg(F.max(metric).alias("best"), F.max(F.when(F.col(workers) == 1, F.col(metric))).alias("serial"))
    one = one.select("best", F.coalesce("serial", "best").alias("baseline"))
    return one.withColumn("improvement", F.when(F.col("baseline") > 0, (F.col("best") - F.col("baseline")) / F.col("baseline")).otherwise(0.0))


def frontier_prefix_max(trials: DataFrame, speed: str, quality: str) -> DataFrame:
    """Points that beat every slower one: a scan in order of speed. It isn't the non-dominated set."""
    known = trials.where(F.col(speed).isNotNull() & F.col(quality).isNotNull())
    return so_far(known, [speed, "trial_id"], quality).where(F.col(quality) > F.col("__top")).drop("__top")


def tradeoff(trials: DataFrame, speed: str, quality: str) -> DataFrame:
    """Each trial's speed and quality with `on_frontier`: what the scatter of a sweep and the line through its frontier show.

    Trials that lack either measure are left out, equal speeds go by trial_id. The frontier is that of `frontier_prefix_max`.
    """
    known = trials.where(F.col(speed).isNotNull() & F.col(quality).isNotNull()).select("mode", "trial_id", speed, quality)
    return so_far(known, [speed, "trial_id"], quality).withColumn("on_frontier", F.col(quality) > F.col("__top")).drop("__top")


def training_curves(log: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, epoch, series, mean, lowest, highest, n): each measure's course over the epochs of a log, over all its trainings.

    Measures that the log lacks have no row, nor have epochs in which none told the measure. Without `by`, all trainings
    are one; with it, each of its groups has curves of its own. One shuffle of a row for each task, group, epoch and series.
    """
    there = [m for m in measures if m in log.columns]
    if not there:
        raise ValueError(f"the log has none of {', '.join(measures)}")
    said = F.array(*[F.struct(F.lit(m).alias("series"), F.col(m).cast("double").alias("value")) for m in there])
    rows = log.select(*(by or []), "epoch", F.explode(said).alias("s")).where("s.value is not null")
    value = F.col("s.value")
    each = rows.groupBy(*(by or []), "epoch", F.col("s.series").alias("series"))
    return each.agg(F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("n"))


def pareto(trials: DataFrame, speed: str, quality: str) -> DataFrame:
    """Points that no other beats in one measure without losing in the other; equal points stay all.

    Of each speed the best quality counts, if it beats that of every strictly higher speed; the front of those, one row
    a speed, then picks its points.
    """
    best_at = trials.where(F.col(speed).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(speed).alias("__speed")).agg(F.max(quality).alias("__best"))
    front = so_far(best_at, [F.desc("__speed")], "__best").where(F.col("__best") > F.col("__top")).select("__speed", "__best")
    return trials.join(front, (F.col(speed) == F.col("__speed")) & (F.col(quality) == F.col("__best"))).drop("__speed", "__best")


def summary(trials: DataFrame, metric: str, speed: str, quality: str, n: int = 10) -> DataFrame:
    """(section, rank, trial columns): the best trial, the n best, and the frontier in order of speed, one under another."""
    top = best(trials, metric, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), "trial_id")))  # n rows
    front = ranked(frontier_prefix_max(trials, speed, quality), speed, "trial_id")
    parts = ((top.where("rank = 1"), "best"), (top, "top"), (front, "frontier"))
    return union_all_by_name([df.select(F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"), *trials.columns) for df, name in parts])


def summary_text(found: DataFrame, columns: list[str]) -> str:
    """`summary` as text, a line for each row: what a report of a sweep prints. As long as the summary."""
    lines: list[str] = []
    rows = found.collect()
    for section in ("best", "top", "frontier"):
        lines.append(f"{section}:")
        for r in sorted((r for r in rows if r["section"] == section), key=lambda r: r["rank"]):
            lines.append("  " + ", ".join(f"{c}={r[c]:.6g}" if isinstance(r[c], float) else f"{c}={r[c]}" for c in columns))
    return "\n".join(lines) + "\n"


def throughput(epochs: DataFrame, warmup: int = 1) -> DataFrame:
    """(trial_id, avg_epoch_s, graphs_per_s): means over epochs after the warm-up, over all where there are none. epochs: trial_id, epoch, seconds, graphs."""
    late = F.col("epoch") > warmup
    kept = epochs.withColumn("__late", F.max(late).over(Window.partitionBy("trial_id"))).where(late | ~F.col("__late"))
    return kept.groupBy("trial_id").agg(F.avg("seconds").alias("avg_epoch_s"), F.avg(F.col("graphs") / F.col("seconds")).alias("graphs_per_s"))


def separation(scores: DataFrame, target: float) -> DataFrame:
    """One row: mean goodness of positives and negatives, their difference, and the share on its own side of the target."""
    right = F.count_if(F.col("g_pos") > target) + F.count_if(F.col("g_neg") <= target)
    rows = scores.agg(F.avg("g_pos").alias("eval_g_pos"), F.avg("g_neg").alias("eval_g_neg"), (right / (2 * F.count("*"))).alias("eval_acc"))
    return rows.withColumn("eval_sep", F.col("eval_g_pos") - F.col("eval_g_neg"))
