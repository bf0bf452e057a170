"""Spark jobs over graphs: packing, scoring, negatives, synthetic windows, training, scenario books, trials.

A graph travels as one row with its nodes and edges as arrays; its size is that of one date's tickers, whatever the
length of the history. Work is spread over graphs; only weights and their summed gradients pass through the driver.
"""

from __future__ import annotations

import dataclasses
import datetime
import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EPS
from ..operators import graph as graphs
from ..operators import risk, trials
from ..sources.storage import stored
from . import kernels
from .kernels import Graph, Hallucination, Layers

PACKED = "date date, tickers array<string>, x array<array<double>>, src array<int>, dst array<int>, corr array<double>, weight array<double>, ret_mean array<double>, ret_std array<double>"


#: What scoring and training read of a graph: neither its tickers nor what undoes its scaling.
LEARNT = ("date", "x", "src", "dst", "corr", "weight")

# The columns of a training's log.
LOG = "epoch int, loss double, g_pos double, g_neg double, hallucinate_ratio double, gate_ratio double, hall_hardness double, energy_penalty double, risk_loss double"


def edge_table(windows: DataFrame, k: int = 5, mode: str = "abs", norm: bool = True) -> DataFrame:
    """(date, src, dst, corr, weight, edge_weight) of the top-k graph; without norm the edge weight is the weight."""
    return graphs.weighted_edges(windows, k, mode, norm)


def pack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each date: tickers in order, their features, edges by the tickers' places. Dates without an edge are left out."""
    by_date = nodes.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "x", "ret_mean", "ret_std"))).alias("n"))
    by_edge = edges.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "corr", "edge_weight"))).alias("e"))
    rows = by_date.join(by_edge, "date")
    place = F.map_from_arrays("n.ticker", F.sequence(F.lit(0), F.size("n") - 1))
    rows = rows.withColumn("place", place)
    ends = [F.transform(f"e.{c}", lambda t: F.element_at("place", t)).alias(c) for c in ("src", "dst")]
    return rows.select("date", F.col("n.ticker").alias("tickers"), F.col("n.x").alias("x"), *ends, F.col("e.corr").alias("corr"), F.col("e.edge_weight").alias("weight"), F.col("n.ret_mean").alias("ret_mean"), F.col("n.ret_std").alias("ret_std"))


def _scored(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (nodes, steps) as `node_features` has them in its mode `window`: z-scores, means and guarded deviations, summed in the same order."""
    steps = np.ascontiguousarray(w.T)

    def mean(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(rows.shape[1])
        for r in rows:
            total += r
        return total / len(rows)

    m = mean(steps)
    centred = steps - m
    s = np.sqrt(mean(centred * centred)) + EPS
    return np.ascontiguousarray((centred / s).T), m, s


def packed_graphs(nodes: DataFrame, k: int | None = 5, threshold: float | None = None, symmetric: bool = True, mode: str = "abs", norm: bool = True) -> DataFrame:
    """As `pack` of the nodes (date, ticker, w, x, ret_mean, ret_std) and their edges, all of a date in one task: one shuffle, by date.

    Nodes may be windows alone (date, ticker, w): then their features are the windows' z-scores, made in that task. A task
    holds a date's nodes and a block of rows of its correlation matrix. Dates without an edge are left out.
    """
    how = graphs.Edges(k, threshold, symmetric, mode, norm)
    given = "x" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        tickers, order, w = graphs._windows_of(table)
        src, dst, corr, weight = how.of(w)
        if not len(src):
            return
        if given:
            own = table.take(pa.array(order))
            lists = [own.column(c).combine_chunks() for c in ("x", "ret_mean", "ret_std")]
        else:
            x, *undo = _scored(w)
            lists = [_rows_of(x), *(pa.array(v) for v in undo)]
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
        columns = [pa.array([table.column("date")[0].as_py()], pa.date32()), one(tickers, None), one(lists[0], None), one(src, pa.int32()), one(dst, pa.int32()), one(corr, pa.float64()), one(weight, pa.float64()), one(lists[1], None), one(lists[2], None)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])

    return nodes.select("date", "ticker", "w", *(("x", "ret_mean", "ret_std") if given else ())).groupBy("date").applyInArrow(run, PACKED)


def stored_graphs(packed: DataFrame, kind: str) -> DataFrame:
    """As `stored`. A graph's row may be long, so that a task holds about 32 MB of them at once, and one graph more, as it writes and reads."""
    return stored(packed, kind, **{"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1"})


def _graphs(batch: pa.RecordBatch) -> Iterator[Graph]:
    """The graphs of a batch, from its buffers: no list of lists is made of them."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    nodes = batch.column("x").offsets.to_numpy()
    inner, values = flat(batch.column("x").values)
    ends = {c: flat(batch.column(c)) for c in ("src", "dst", "corr", "weight")}
    for i in range(batch.num_rows):
        a, b = nodes[i], nodes[i + 1]
        x = values[inner[a] : inner[b]].astype(float).reshape(b - a, -1)
        src, dst, corr, weight = (v[at[i] : at[i + 1]] for at, v in ends.values())
        yield Graph(x, src.astype(int), dst.astype(int), corr.astype(float), weight.astype(float))


def _rng(seed: int, date) -> np.random.Generator:
    """Of the seed and the graph alone, so that partitions and retries change nothing."""
    return np.random.default_rng([seed, pd.Timestamp(date).toordinal()])


def score(packed: DataFrame, layers: Layers, temperature: float = 1.0) -> DataFrame:
    """(date, goodness) of each graph under the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kernels.goodness(kernels.forward(layers, g, g.x)[-1][1], temperature)[0] for g in _graphs(b)]
            yield pa.RecordBatch.from_arrays([b.column("date"), pa.array(found, pa.float64())], ["date", "goodness"])

    return packed.select(*LEARNT).mapInArrow(run, "date date, goodness double")


def _rows_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _with_x(packed: DataFrame, change: Callable[[Graph, datetime.date], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """The graphs with other features, all their columns or those of `keep`; no other column goes to Python and back."""
    packed = packed.select(*[c for c in packed.columns if not keep or c in keep or c in LEARNT])
    given = [c for c in packed.columns if not keep or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("x")
            for i, (g, date) in enumerate(zip(_graphs(b), b.column("date").to_pylist())):
                x = _rows_of(change(g, date))
                columns = b.slice(i, 1).columns
                columns[at] = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([columns[b.schema.names.index(c)] for c in given], given)

    return packed.mapInArrow(run, packed.select(*given).schema)


def negatives(packed: DataFrame, mode: str, window: int, noise: float = 0.05, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The graphs with negative features: nodes shuffled, noise added, returns reversed, as the mode says. keep: the columns wanted, if not all."""
    return _with_x(packed, lambda g, date: kernels.negative(g.x, mode, window, noise, _rng(seed, date)), keep)


def hallucinate(packed: DataFrame, layers: Layers, config: Hallucination = Hallucination(), seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The graphs with synthetic features of higher goodness. keep: the columns wanted, if not all."""
    return _with_x(packed, lambda g, date: kernels.hallucinate(layers, g, config, _rng(seed, date)), keep)


@dataclasses.dataclass(frozen=True)
class Training:
    """How a model is trained. style: e2e, layerwise, multiscale or backprop (a supervised head on pooled nodes).

    layerwise: each layer learns from its own input, that of the layer below, against a negative made of it by
    layer_negative and layer_noise, or hallucinated under that layer alone where `negative` says so; then layer_corr,
    layer_mean and layer_std stand for the hallucination's weights (None: those), and its energy is not counted.

    negative: a mode of `kernels.negative`, `hallucinate`, `schedule` (shuffled until `warmup`, then hallucinated) or `mix`
    (after it hallucinated with a chance that goes from mix_start to mix_end over `ramp` epochs). curriculum: fields of the
    hallucination with their first and last value, moved over curriculum_ramp epochs from curriculum_start. risk_weight:
    of the loss (huber or mse) of a linear head on the pooled nodes against each graph's target; not for layerwise.
    """

    style: str = "e2e"
    hidden: int = 32
    layers: int = 2
    epochs: int = 5
    batches: int = 1
    lr: float = 1e-2
    target: float = 2.0
    temperature: float = 1.0
    negative: str = "shuffle"
    noise: float = 0.05
    layer_negative: str = "shuffle"
    layer_noise: float | None = None
    layer_corr: float | None = 0.0
    layer_mean: float | None = None
    layer_std: float | None = None
    warmup: int = 1
    mix_start: float = 0.0
    mix_end: float = 1.0
    ramp: int = 5
    curriculum: tuple[tuple[str, float, float], ...] = ()
    curriculum_start: int = 1
    curriculum_ramp: int = 1
    dropout: float = 0.0
    risk_weight: float = 0.1
    risk_kind: str = "huber"
    hallucination: Hallucination = Hallucination(steps=3)
    gate_margin: float | None = None
    energy: float = 0.0
    clip: float = 1.0
    seed: int = 7

    def at(self, epoch: int) -> Hallucination:
        """The hallucination's settings in an epoch: whole numbers half to even and at least 1, shares within 0 and 1."""
        t = 0.0 if epoch < self.curriculum_start else min(1.0, (epoch - self.curriculum_start) / max(1, self.curriculum_ramp))
        now: dict[str, float] = {name: a + t * (b - a) for name, a, b in self.curriculum}
        now |= {k: max(1, round(now[k])) for k in ("steps", "node_min") if k in now}
        now |= {k: min(1.0, max(0.0, now[k])) for k in ("node_fraction",) if k in now}
        return dataclasses.replace(self.hallucination, temperature=self.temperature, **now)

    def hallucinated(self, epoch: int) -> float:
        """The chance of a hallucinated negative in an epoch of `mix`."""
        progress = min(1.0, (epoch - self.warmup) / max(1, self.ramp))
        return 0.0 if epoch <= self.warmup else self.mix_start + progress * (self.mix_end - self.mix_start)

    def at_layer(self, epoch: int) -> Hallucination:
        """The hallucination's settings within one layer."""
        own = {f"{k}_weight": v for k, v in (("corr", self.layer_corr), ("mean", self.layer_mean), ("std", self.layer_std)) if v is not None}
        return dataclasses.replace(self.at(epoch), **own)

    def mode(self, epoch: int, rng: np.random.Generator) -> str:
        """How a graph's negative is made in an epoch."""
        if self.negative == "schedule":
            return "shuffle" if epoch <= self.warmup else "hallucinate"
        if self.negative == "mix":
            return "hallucinate" if rng.random() < self.hallucinated(epoch) else "shuffle"
        return self.negative


#: What a step tells of a graph, in this order: sums over negatives from `made` on.
TOLD = ("loss", "g_pos", "g_neg", "energy", "made", "hallucinated", "gated", "hardness")


def _hallucinated(layers: Layers, g: Graph, c: Training, settings: Hallucination, window: int, rng: np.random.Generator, tally: np.ndarray) -> np.ndarray:
    """A hallucinated negative; one that is far better than the real one teaches nothing yet, so a shuffled one stands for it."""
    found = kernels.hallucinate(layers, g, settings, rng)
    good = [kernels.goodness(kernels.forward(layers, g, x)[-1][1], c.temperature)[0] for x in (g.x, found)]
    if c.gate_margin is not None and good[1] > good[0] + c.gate_margin:
        tally += [1, 0, 1, 0]
        return kernels.negative(g.x, "shuffle", window, c.noise, rng)
    tally += [1, 1, 0, good[1] - good[0]]
    return found


def _negatives_of(g: Graph, layers: Layers, c: Training, window: int, rng: np.random.Generator, epoch: int, tally: np.ndarray) -> list[np.ndarray]:
    mode = c.mode(epoch, rng)
    if mode == "hallucinate":
        found = _hallucinated(layers, g, c, c.at(epoch), window, rng, tally)
    else:
        tally += [1, 0, 0, 0]
        found = kernels.negative(g.x, mode, window, c.noise, rng)
    return [found, kernels.negative(g.x, "time_flip", window, c.noise, rng)] if c.style == "multiscale" else [found]


def _layer_negative(g: Graph, layers: Layers, c: Training, window: int, rng: np.random.Generator, epoch: int, mode: str, tally: np.ndarray, i: int, x: np.ndarray) -> np.ndarray:
    """Layer i's negative of its input x: hallucinated under that layer alone, or x changed as layer_negative says."""
    if mode == "hallucinate":
        return _hallucinated([layers[i]], g.with_x(x), c, c.at_layer(epoch), window, rng, tally)
    tally += [1, 0, 0, 0]
    return kernels.negative(x, c.layer_negative, window, c.noise if c.layer_noise is None else c.layer_noise, rng)


def _graph_step(layers: Layers, head: np.ndarray, g: Graph, c: Training, window: int, rng: np.random.Generator, epoch: int) -> tuple[np.ndarray, Layers, np.ndarray]:
    """What TOLD names, gradients of the layers, gradient of the head."""
    tally = np.zeros(4)
    drop = kernels.Dropout(c.dropout, rng) if c.dropout > 0 else None
    if c.style == "layerwise":
        bad = functools.partial(_layer_negative, g, layers, c, window, rng, epoch, c.mode(epoch, rng), tally)
        said, grads = kernels.layerwise_step(layers, g, bad, c.target, c.temperature, drop)
        return np.concatenate((said, [0.0], tally)), grads, np.zeros_like(head)
    bad = _negatives_of(g, layers, c, window, rng, epoch, tally)
    if c.style != "backprop":
        said, grads = kernels.ff_step(layers, g, bad, c.target, c.temperature, c.style, c.energy, drop)
        energy = 0.0
        if c.energy > 0:
            energy = c.energy * np.mean([(h * h).mean() for _, h in kernels.forward(layers, g, g.x)][-1 if c.style == "e2e" else 0 :])
        return np.concatenate((said, [energy], tally)), grads, np.zeros_like(head)
    sums, d_head, loss = None, np.zeros_like(head), 0.0
    for x, y in ((g.x, 1.0), (bad[0], 0.0)):
        value, grads, dw, db = kernels.pooled_step(layers, (head[:-1], head[-1]), g, x, y, "bce", drop)
        loss, d_head = loss + value / 2, d_head + np.append(dw, db) / 2
        sums = [(w / 2, b / 2) for w, b in grads] if sums is None else [(w + dw2 / 2, b + db2 / 2) for (w, b), (dw2, db2) in zip(sums, grads)]
    good = [kernels.goodness(kernels.forward(layers, g, x)[-1][1], c.temperature)[0] for x in (g.x, bad[0])]
    return np.concatenate(([loss, *good, 0.0], tally)), sums, d_head


def _flat(layers: Layers, head: np.ndarray) -> np.ndarray:
    return np.concatenate([*(a.ravel() for pair in layers for a in pair), head])


def _unflat(flat: np.ndarray, like: Layers) -> tuple[Layers, np.ndarray]:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out, flat[at:]


def train(packed: DataFrame, window: int, width: int, c: Training = Training(), targets: DataFrame | None = None) -> tuple[Layers, list[dict]]:
    """A model, and what each epoch told: loss, g_pos, g_neg, hallucinate_ratio, gate_ratio, hall_hardness, energy_penalty, risk_loss (null without a risk head).

    One Spark job for each batch of an epoch: every task sums its graphs' gradients into one row; the rows, as many as
    tasks, meet in one aggregate as long as the model. Graphs are dealt to batches by a hash of their date. Read `packed`
    from a table or cache it: each job scans it. targets (date, target): what the risk head learns; graphs without one, or
    with one that isn't finite, leave it alone.
    """
    layers, _, log, _ = train_all(packed, window, width, [c], targets)[0]
    return layers, log


def train_with_head(packed: DataFrame, window: int, width: int, c: Training = Training(), targets: DataFrame | None = None) -> tuple[Layers, np.ndarray, list[dict]]:
    """As `train`, with the linear head's weights and bias: that of the risk, or of the labels for backprop."""
    return train_all(packed, window, width, [c], targets)[0][:3]


def _risk_step(layers: Layers, head: np.ndarray, g: Graph, target: float, c: Training) -> tuple[float, Layers, np.ndarray]:
    loss, grads, dw, db = kernels.pooled_step(layers, (head[:-1], head[-1]), g, g.x, target, c.risk_kind)
    return loss, grads, np.append(dw, db)


class _Model:
    """A model in training: its weights between steps, and what its epochs told."""

    def __init__(self, c: Training, width: int, targets: bool):
        self.c, self.risk = c, targets and c.style in ("e2e", "multiscale")
        self.layers, self.head, self.adam = kernels.new_layers(width, c.hidden, c.layers, c.seed), np.zeros(c.hidden + 1), kernels.Adam(c.lr)
        self.log: list[dict] = []
        self.took: list[tuple[float, int]] = []
        self.told: list[tuple[int, np.ndarray]] = []
        self.risks: list[tuple[float, float]] = []
        self.seconds = 0.0

    def at(self, step: int) -> tuple[int, int] | None:
        """The epoch, from 1, and the batch of a step; None when all are done."""
        epoch, batch = divmod(step, self.c.batches)
        return (epoch + 1, batch) if epoch < self.c.epochs else None

    def step(self, n: int, sums: np.ndarray) -> None:
        """One step by a batch's sums over n graphs."""
        c, told, size = self.c, len(TOLD), len(_flat(self.layers, self.head))
        mean = sums[: told + size] / n
        if self.risk and (known := sums[told + size]) > 0:
            mean[0] += c.risk_weight * sums[told + size + 1] / known
            mean[told:] += c.risk_weight * sums[told + size + 2 :] / known
            self.risks.append((sums[told + size + 1] / known, known))
        grads, d_head = _unflat(mean[told:], self.layers)
        grads = [kernels.clipped([x], c.clip)[0] for x in grads] if c.style == "layerwise" else kernels.clipped(grads, c.clip)
        self.adam.t += 1
        self.layers = [(self.adam.step((i, 0), w, dw), self.adam.step((i, 1), b, db)) for i, ((w, b), (dw, db)) in enumerate(zip(self.layers, grads))]
        self.head = self.adam.step("head", self.head, d_head) if c.style == "backprop" or self.risk else self.head
        self.told.append((n, mean[:told]))

    def end_epoch(self, epoch: int) -> None:
        if self.told:
            at = dict(zip(TOLD, np.average([m for _, m in self.told], axis=0, weights=[n for n, _ in self.told])))
            risk_loss = float(np.average([x for x, _ in self.risks], weights=[n for _, n in self.risks])) if self.risks else None
            made, used = at["made"] or 1.0, at["hallucinated"]
            log = {"epoch": epoch, "loss": at["loss"], "g_pos": at["g_pos"], "g_neg": at["g_neg"], "hallucinate_ratio": used / made, "gate_ratio": at["gated"] / made, "hall_hardness": at["hardness"] / used if used else 0.0, "energy_penalty": at["energy"]}
            self.log.append({k: float(v) if k != "epoch" else v for k, v in log.items()} | {"risk_loss": risk_loss})
            self.took.append((self.seconds, int(sum(n for n, _ in self.told))))
        self.told, self.risks, self.seconds = [], [], 0.0


def train_all(packed: DataFrame, window: int, width: int, plans: list[Training], targets: DataFrame | None = None) -> list[tuple[Layers, np.ndarray, list[dict], list[tuple[float, int]]]]:
    """For each plan its model, as `train` makes it: layers, head, log, and for each epoch its seconds and graphs.

    All plans learn side by side: a job carries the weights of every model that still learns, a task sums the gradients of
    each into one row, and the rows meet by (model, place). So jobs grow with the longest plan's steps and not with the
    number of plans. A graph is read once a job, by the models whose batch it is in.
    """
    models = [_Model(c, width, targets is not None) for c in plans]
    packed = packed.select(*LEARNT)
    if any(m.risk for m in models):  # a target a graph: these are kept, and meet the graphs anew in each job
        packed = packed.join(F.broadcast(stored(targets.select("date", F.col("target").alias("risk_target")), "targets")), "date", "left")
    deal = F.xxhash64("date")
    rows = packed.withColumn("deal", deal)
    for step in range(max((c.epochs * c.batches for c in plans), default=0)):
        began = time.perf_counter()
        now = [(i, m.c, m.layers, m.head, m.risk, *at) for i, m in enumerate(models) if (at := m.at(step)) is not None]
        in_turn = {(c.batches, batch) for _, c, _, _, _, _, batch in now}
        mine = functools.reduce(lambda a, b: a | b, (F.pmod("deal", F.lit(n)) == batch for n, batch in sorted(in_turn)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                dates, deals = b.column("date").to_pylist(), b.column("deal").to_pylist()
                known = b.column("risk_target").to_pylist() if "risk_target" in b.schema.names else [None] * len(dates)
                for date, deal, y, g in zip(dates, deals, known, _graphs(b)):
                    for i, c, layers, head, risk, epoch, batch in now:
                        if deal % c.batches != batch:
                            continue
                        said, grads, d_head = _graph_step(layers, head, g, c, window, _rng(c.seed * 1000 + epoch, date), epoch)
                        row = np.concatenate((said, _flat(grads, d_head)))
                        if risk:  # the risk's sums stand behind, since they are divided by another count
                            aside = np.zeros(2 + len(row) - len(said))
                            if y is not None and np.isfinite(y):
                                loss, grads, d_head = _risk_step(layers, head, g, y, c)
                                aside = np.concatenate(([1.0, loss], _flat(grads, d_head)))
                            row = np.concatenate((row, aside))
                        held = total.setdefault(i, [0, 0.0])
                        held[0], held[1] = held[0] + 1, held[1] + row
            if total:
                arrays = [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v.tolist() for _, v in total.values()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["model", "n", "sums"])

        sums = rows.where(mine).mapInArrow(run, "model int, n bigint, sums array<double>").select("model", "n", F.posexplode("sums").alias("at", "v"))
        found = sums.groupBy("model", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()  # as long as the models
        model, at, v, n = (found.column(c).to_numpy() for c in ("model", "at", "v", "n"))
        seconds = time.perf_counter() - began
        for i in np.unique(model):
            own = np.flatnonzero(model == i)
            own = own[np.argsort(at[own])]
            models[i].step(int(n[own[0]]), v[own])
        for i, c, _, _, _, epoch, batch in now:
            models[i].seconds += seconds
            if batch == c.batches - 1:
                models[i].end_epoch(epoch)
    return [(m.layers, m.head, m.log, m.took) for m in models]


def benchmark(packed: DataFrame, window: int, width: int, base: Training = Training(), modes: tuple[str, ...] = ("layerwise", "e2e", "backprop"), warmup: int = 1) -> DataFrame:
    """(mode, avg_epoch_s, graphs_per_s, eval_acc, eval_bce, eval_g_neg, eval_g_pos, eval_sep): each style trained on four fifths, timed after the warm-up epochs, tested on the rest.

    eval_acc is the share of graphs on their own side: of the target by goodness, or of the head's label for backprop;
    eval_bce is the head's and null elsewhere. Negatives of the test are shuffled nodes. Read `packed` from a table or cache
    it: its dates are read by themselves, and then its graphs twice.
    """
    parts = stored(trials.split(packed.select("date"), 0.2, key="date"), "split")
    learned, held = (packed.select(*LEARNT).join(parts.where(F.col("part") == part), "date", "left_semi") for part in ("train", "eval"))
    learned, held = stored_graphs(learned, "train"), stored_graphs(held, "eval")
    rows = []
    for mode in modes:
        c = dataclasses.replace(base, style=mode)
        layers, head, _, took = train_all(learned, window, width, [c])[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for g, date in zip(_graphs(b), b.column("date").to_pylist()):
                    bad = kernels.negative(g.x, "shuffle", window, c.noise, _rng(c.seed, date))
                    last = [kernels.forward(layers, g, x)[-1][1] for x in (g.x, bad)]
                    pos, neg = (kernels.goodness(h, c.temperature)[0] for h in last)
                    z = [float(h.mean(axis=0) @ head[:-1] + head[-1]) for h in last]
                    right = int(z[0] > 0) + int(z[1] <= 0) if mode == "backprop" else int(pos > c.target) + int(neg <= c.target)
                    bce = float(np.logaddexp(0, -z[0]) + np.logaddexp(0, z[1])) / 2 if mode == "backprop" else None
                    out.append({"pos": pos, "neg": neg, "right": right, "bce": bce})
                yield pa.RecordBatch.from_pylist(out, pa.schema({"pos": pa.float64(), "neg": pa.float64(), "right": pa.int32(), "bce": pa.float64()}))

        tested = held.mapInArrow(run, "pos double, neg double, right int, bce double")
        told = tested.agg(F.avg("pos").alias("p"), F.avg("neg").alias("n"), (F.sum("right") / (2 * F.count("*"))).alias("acc"), F.avg("bce").alias("bce")).first()
        late = took[warmup:] or took
        seconds = sum(s for s, _ in late) / max(1, len(late))
        rate = sum(n for _, n in late) / max(1e-9, sum(s for s, _ in late))
        sep = told["p"] - told["n"] if told["p"] is not None else None
        rows.append((mode, seconds, rate, told["acc"], told["bce"], told["n"], told["p"], sep))
    return packed.sparkSession.createDataFrame(rows, "mode string, avg_epoch_s double, graphs_per_s double, eval_acc double, eval_bce double, eval_g_neg double, eval_g_pos double, eval_sep double")


def tune(packed: DataFrame, window: int, width: int, base: Training = Training(), partitions: tuple[int, ...] = (1, 2, 4, 8), batch_rows: tuple[int, ...] = (64, 1000), sample: int = 256) -> DataFrame:
    """(parallel_workers, batch_rows, graphs_seen, wall_time_s, graphs_per_s): training on one sample, with each number of partitions and of rows in an Arrow batch.

    The sample is the first graphs by date. The first epoch of each setting warms up and is not timed, so `base` has two at
    least. The session's own batch size is put back at the end.
    """
    if base.epochs < 2:
        raise ValueError("the first epoch is not timed; train for two at least")
    spark, key = packed.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), []
    # The dates are picked by themselves, so that no graph is sorted.
    kept = packed.join(F.broadcast(packed.select("date").orderBy("date").limit(sample)), "date", "left_semi")
    try:
        for n in partitions:
            dealt = stored_graphs(kept.repartition(n, "date"), "sample")
            for size in batch_rows:
                spark.conf.set(key, str(size))
                took = train_all(dealt.coalesce(n), window, width, [base])[0][3][1:]
                seconds, seen = sum(s for s, _ in took), sum(g for _, g in took)
                rows.append((n, size, seen, seconds, seen / max(seconds, 1e-9)))
    finally:
        spark.conf.set(key, before)
    return spark.createDataFrame(rows, "parallel_workers int, batch_rows int, graphs_seen int, wall_time_s double, graphs_per_s double")


def best_setting(tuned: DataFrame) -> dict[str, int]:
    """The fastest setting of `tune`; of equal ones that with the fewest partitions and then rows."""
    best = tuned.orderBy(F.desc("graphs_per_s"), "parallel_workers", "batch_rows").first()
    return {k: best[k] for k in ("parallel_workers", "batch_rows")}


def model_table(spark, layers: Layers) -> DataFrame:
    """(layer, name, shape, data): a model as rows, to be written and read again."""
    rows = [(i, name, list(a.shape), a.ravel().tolist()) for i, pair in enumerate(layers) for name, a in zip(("weight", "bias"), pair)]
    return spark.createDataFrame(rows, "layer int, name string, shape array<int>, data array<double>")


def model_from(table: DataFrame) -> Layers:
    found = {(r["layer"], r["name"]): np.array(r["data"]).reshape(r["shape"]) for r in table.collect()}
    return [(found[i, "weight"], found[i, "bias"]) for i in range(len(found) // 2)]


def scenario_book(packed: DataFrame, layers: Layers, window: int, ticker: str, target: float, config: Hallucination, weight: float, kind: str = "at_least", seed: int = 0) -> DataFrame:
    """(date, ticker, real, halluc): real and synthetic returns of each graph that holds the ticker, bent towards its target return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (g, date) in enumerate(zip(_graphs(b), b.column("date"))):
                tickers = b.column("tickers")[i].values
                node = pc.index(tickers, ticker).as_py()
                mean, std = (np.nan_to_num(b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float), nan=d) for c, d in (("ret_mean", 0.0), ("ret_std", 1.0)))

                def constraint(x: np.ndarray) -> tuple[float, np.ndarray]:
                    return kernels.drop_constraint(x, node, window, mean[node], std[node], target, weight, kind)

                x = kernels.hallucinate(layers, g, config, _rng(seed, date.as_py()), constraint, (node,))
                real, hall = (v[:, :window] * std[:, None] + mean[:, None] for v in (g.x, x))
                yield pa.RecordBatch.from_arrays([pa.repeat(date, len(tickers)), tickers, _rows_of(real), _rows_of(hall)], ["date", "ticker", "real", "halluc"])

    return packed.where(F.array_contains("tickers", ticker)).mapInArrow(run, "date date, ticker string, real array<double>, halluc array<double>")


@dataclasses.dataclass(frozen=True)
class Controller:
    """How a scenario book's settings follow its hit rate: factors and steps of one move, and bounds that no move leaves."""

    # The controller's defaults.
    weight_factor: float = 1.5
    weight_bounds: tuple[float, float] = (1.0, 1000.0)
    lr_factor: float = 1.2
    loosen_factor: float = 0.8
    fine_lr_factor: float = 1.05
    fine_steps: int = 1
    steps: int = 5
    steps_bounds: tuple[int, int] = (1, 60)
    node_fraction: float = 0.1
    node_fraction_bounds: tuple[float, float] = (0.1, 1.0)
    clamp_std: float = 0.5
    clamp_std_bounds: tuple[float, float] = (1.0, 6.0)
    lr_bounds: tuple[float, float] = (0.001, 0.5)
    l2_bounds: tuple[float, float] = (0.001, 0.2)
    mean_bounds: tuple[float, float] = (0.001, 0.2)
    std_bounds: tuple[float, float] = (0.001, 0.2)
    corr_bounds: tuple[float, float] = (0.01, 1.0)

    def moved(self, weight: float, config: Hallucination, mean_diff: float, tolerance: float) -> tuple[float, Hallucination]:
        """The constraint's weight and the windows' settings for the next attempt.

        Where the mean misses the target by no more than the tolerance, windows get a little more time. Above it the
        constraint was too weak: it gets stronger and the windows freer; below it the opposite.
        """

        def held(value: float, bounds: tuple[float, float]) -> float:
            return min(max(value, bounds[0]), bounds[1])

        if abs(mean_diff) <= tolerance:
            steps, lr = min(config.steps + self.fine_steps, self.steps_bounds[1]), min(config.lr * self.fine_lr_factor, self.lr_bounds[1])
            return weight, dataclasses.replace(config, steps=steps, lr=lr)
        up = mean_diff > tolerance
        sign = 1 if up else -1
        loosen = self.loosen_factor**sign
        return held(weight * self.weight_factor**sign, self.weight_bounds), dataclasses.replace(
            config,
            lr=held(config.lr * self.lr_factor**sign, self.lr_bounds),
            l2_weight=held(config.l2_weight * loosen, self.l2_bounds),
            mean_weight=held(config.mean_weight * loosen, self.mean_bounds),
            std_weight=held(config.std_weight * loosen, self.std_bounds),
            corr_weight=held(config.corr_weight * loosen, self.corr_bounds),
            steps=int(held(config.steps + sign * self.steps, self.steps_bounds)),
            node_fraction=held(config.node_fraction + sign * self.node_fraction, self.node_fraction_bounds),
            clamp_std=held((config.clamp_std or Hallucination.clamp_std) + sign * self.clamp_std, self.clamp_std_bounds),
        )


def adaptive_book(packed: DataFrame, layers: Layers, window: int, ticker: str, target: float, config: Hallucination = Hallucination(), weight: float = 10.0, tolerance: float = 0.01, hit_rate: float = 0.6, attempts: int = 4, seed: int = 0, controller: Controller = Controller()) -> tuple[DataFrame, list[dict]]:
    """A scenario book whose settings follow its hit rate, and what each attempt told. One job for each attempt.

    The controller moves the settings between attempts; where it can move none of them any more, the book is done.
    """
    log, book = [], None
    for attempt in range(1, attempts + 1):
        # Each attempt is written once: its diagnosis and, of the last, the caller read the table.
        book = stored(scenario_book(packed, layers, window, ticker, target, config, weight, seed=seed), "book")
        diag = risk.scenario_diagnostics(book.where(F.col("ticker") == ticker), target)
        told = risk.hit_summary(diag, tolerance).first().asDict()
        log.append({"attempt": attempt, "weight": weight, **told})
        if not told["n"] or told["hit_rate"] >= hit_rate:
            break
        before = (weight, config)
        weight, config = controller.moved(weight, config, told["mean_diff"], tolerance)
        if (weight, config) == before:
            break
    return book, log


def run_trials(grid: DataFrame, packed: DataFrame, window: int, base: Training = Training()) -> DataFrame:
    """(trial_id, mode, eval_g_pos, eval_g_neg, eval_sep, eval_acc) of each row of `grid`: a model trained on four fifths of all graphs, tested on the rest.

    grid's columns beside trial_id, seed and mode name fields of Training. All trials share one split and learn side by
    side, as by `train_all`; one pass over the graphs held out tests them all. A single graph is both trained and tested on.
    """
    parts = stored(trials.split(packed.select("date"), 0.2, key="date"), "split")
    known = {r["part"] for r in parts.select("part").distinct().collect()}
    lean = packed.select(*LEARNT)
    learned, held = (lean.join(parts.where(F.col("part") == part), "date", "left_semi") if part in known else lean for part in ("train", "eval"))
    learned, held = stored_graphs(learned, "train"), stored_graphs(held, "eval")
    first = packed.select(F.size(F.col("x")[0]).alias("width")).first()
    names = [c for c in grid.columns if c not in ("trial_id", "seed", "mode")]
    asked = grid.orderBy("trial_id").collect()  # the plan of trials
    plans = [dataclasses.replace(base, style=t["mode"], seed=int(t["seed"]), **{k: type(getattr(base, k))(t[k]) for k in names}) for t in asked]
    learnt = train_all(learned, window, first["width"] if first else 0, plans)
    models = [(t["trial_id"], t["mode"], c, found[0]) for t, c, found in zip(asked, plans, learnt)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, date in zip(_graphs(b), b.column("date").to_pylist()):
                for trial, mode, c, layers in models:
                    bad = kernels.negative(g.x, "shuffle", window, c.noise, _rng(c.seed, date))
                    pos, neg = (kernels.goodness(kernels.forward(layers, g, x)[-1][1], c.temperature)[0] for x in (g.x, bad))
                    rows.append({"trial_id": trial, "mode": mode, "pos": pos, "neg": neg, "right": int(pos > c.target) + int(neg <= c.target)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"trial_id": pa.int32(), "mode": pa.string(), "pos": pa.float64(), "neg": pa.float64(), "right": pa.int32()}))

    tested = held.mapInArrow(run, "trial_id int, mode string, pos double, neg double, right int").groupBy("trial_id", "mode")
    found = tested.agg(F.avg("pos").alias("eval_g_pos"), F.avg("neg").alias("eval_g_neg"), (F.sum("right") / (2 * F.count("*"))).alias("eval_acc"))
    return found.select("trial_id", "mode", "eval_g_pos", "eval_g_neg", (F.col("eval_g_pos") - F.col("eval_g_neg")).alias("eval_sep"), "eval_acc")
