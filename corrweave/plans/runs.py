"""A whole run from a settings file: clean, build, train, report. Each table is stored under the digest of all that it rests on, and taken up again where it is there."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learn import jobs, kernels
from ..operators import features, membership, returns, risk
from ..sources import raw, reports

# Names of settings, by the fields of Training and Hallucination that they set.
TRAINING = {
    "hidden": "hidden_dim", "layers": "num_layers", "epochs": "epochs", "lr": "lr", "target": "goodness_target", "temperature": "goodness_temp", "negative": "neg_mode",
    "noise": "noise_std", "layer_negative": "layerwise_neg_mode", "layer_noise": "layerwise_noise_std", "layer_corr": "layerwise_hall_corr", "layer_mean": "layerwise_hall_mean",
    "layer_std": "layerwise_hall_std", "warmup": "neg_warmup_epochs", "mix_start": "neg_mix_start", "mix_end": "neg_mix_end", "ramp": "neg_mix_ramp_epochs", "dropout": "dropout",
    "risk_weight": "risk_loss_weight", "risk_kind": "risk_loss_type", "gate_margin": "neg_gate_margin", "energy": "energy_penalty_weight", "clip": "grad_clip", "seed": "seed",
}
HALLUCINATION = {
    "steps": "hallucinate_steps", "lr": "hallucinate_lr", "l2_weight": "hallucinate_l2", "mean_weight": "hallucinate_mean", "std_weight": "hallucinate_std", "corr_weight": "hallucinate_corr",
    "clamp_std": "hallucinate_clamp_std", "node_fraction": "hallucinate_node_fraction", "node_min": "hallucinate_node_min",
}


class Run:
    """Settings, and the tables made by them. `given` (section: {key: value}) goes before the file, the file before defaults."""

    def __init__(self, spark: SparkSession, path: str, out: str, given: dict[str, dict] | None = None):
        self.spark, self.path, self.out, self.given = spark, path, out.rstrip("/"), given or {}
        self.made: list[str] = []
        self.rests: dict[str, str] = {}

    def get(self, section: str, key: str, default=None):
        return reports.setting(key, self.given.get(section, {}).get(key), reports.load_settings(self.path, section), default)

    def asked(self, section: str, *keys: str) -> dict:
        return {k: v for k in keys if (v := self.get(section, k)) is not None}

    def table(self, name: str, make: Callable[[], DataFrame], on: tuple[str, ...] = (), settings=None) -> DataFrame:
        """The table of that name, made if none rests on the same tables and settings; a write that broke off is made anew."""
        said = json.dumps([name, [self.rests[x] for x in on], settings], sort_keys=True, default=str)
        self.rests[name] = hashlib.sha256(said.encode()).hexdigest()[:16]
        where = self.where(name)
        if not self._exists(f"{where}/_SUCCESS"):
            make().write.mode("overwrite").parquet(where)
            self.made.append(name)
        return self.spark.read.parquet(where)

    def where(self, name: str) -> str:
        return f"{self.out}/{name}-{self.rests[name]}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    # Stages

    def clean(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Tidy prices, and constituents and fundamentals where the settings name them, from folders of raw files; `columns` names columns by hand."""
        section = "clean"
        columns = self.get(section, "columns", {}) or {}
        source = lambda key: raw.scan_dir(self.spark, self.get(section, key), self.get(section, "files", "*.csv"), recursive=True)
        if not self.get(section, "prices"):
            raise ValueError("the settings name no prices")
        said = self.asked(section, "prices", "constituents", "fundamentals", "files", "columns", "coarse")

        def prices() -> DataFrame:
            rows = raw.standardize_prices(source("prices"), columns).select("date", "ticker", F.col("adj_close").alias("price"), "volume")
            return membership.first_rows(rows, ["date", "ticker"], ["price", "volume"])

        def constituents() -> DataFrame:
            rows = raw.standardize_constituents(source("constituents"), columns)
            return raw.merge_market_cap(rows, raw.standardize_coarse(source("coarse"), columns), True) if self.get(section, "coarse") else rows

        told = self.table("prices", prices, (), said)
        members = self.table("constituents", constituents, (), said) if self.get(section, "constituents") else None
        funds = self.table("fundamentals", lambda: raw.load_fundamentals(source("fundamentals")).drop("_file", "_line"), (), said) if self.get(section, "fundamentals") else None
        return told, members, funds

    def build(self) -> DataFrame:
        """The graphs, one row a date, and a table of counts of windows kept and skipped."""
        section, (prices, constituents, funds) = "build_graphs", self.clean()
        get = lambda key, default=None: self.get(section, key, default)
        window, step, start, end = get("window", 20), get("step", 1), get("start_date"), get("end_date")
        said = self.asked(section, "window", "step", "top_k", "corr_threshold", "min_nodes", "feature_mode", "rsi_period", "mdy_ticker", "edge_norm", "edge_weight_mode", "normalize", "symmetric", "membership_mode", "membership_fill", "membership_max_gap_days", "start_date", "end_date", "include_tickers")
        on = tuple(x for x in ("prices", "constituents", "fundamentals") if x in self.rests)
        moved = self.table("returns", lambda: returns.in_range(returns.log_returns(prices), start, end).drop("date_idx"), on, said)
        extra = get("include_tickers", [])
        extra = [t.strip() for t in extra.split(",") if t.strip()] if isinstance(extra, str) else list(extra or [])

        members = None
        if get("membership_mode", "constituents") != "all":
            if constituents is None:
                raise ValueError("the settings name no constituents; membership_mode = \"all\" needs none")
            listed = returns.in_range(constituents.where("is_member = 1"), start, end)
            gap = get("membership_max_gap_days")
            filled = get("membership_fill", "none") == "ffill"
            members = membership.members_filled(listed, moved, gap, extra) if filled else membership.members_exact(listed, moved, extra)
            members = self.table("members", lambda: members, ("returns",), said)

        def windows() -> DataFrame:
            rows = returns.complete_windows(moved, window, step)
            return rows if members is None else rows.join(members, ["date", "ticker"], "left_semi")

        kept = self.table("windows", windows, ("returns",), said)
        status = self.table("status", lambda: returns.window_status(moved, returns.complete_windows(moved, window, step), members, window, step, get("min_nodes", 50)), ("windows",), said)

        def graphs() -> DataFrame:
            fit = kept.join(status.where("status = 'ok'"), "date", "left_semi")
            known = None
            if funds is not None:
                names = [c for c in features.FUNDAMENTALS if c in funds.columns]
                known = membership.fundamentals_asof(returns.in_range(funds, start, end), fit, names)
            nodes = features.node_features(fit, get("feature_mode", "window"), get("mdy_ticker", "MDY"), get("rsi_period", 14), get("normalize", True), known)
            threshold = get("corr_threshold")
            return jobs.packed_graphs(nodes, None if threshold is not None else get("top_k", 10), threshold, get("symmetric", True), get("edge_weight_mode", "abs"), get("edge_norm", True))

        found = self.table("graphs", graphs, ("windows", "status"), said)
        bare = lambda: status.where("status = 'ok'").join(found, "date", "left_anti")
        self.table("build_stats", lambda: returns.build_stats(status, bare()), ("graphs",), said)
        return found

    def training(self) -> jobs.Training:
        section = "train"
        fields = {f: v for f, key in TRAINING.items() if (v := self.get(section, key)) is not None}
        own = {f: v for f, key in HALLUCINATION.items() if (v := self.get(section, key)) is not None}
        curriculum = reports.load_settings(self.path, f"{section}.hallucinate_curriculum")
        if curriculum.get("enabled"):
            ramps = [(k.removesuffix("_start"), v, curriculum[f"{k.removesuffix('_start')}_end"]) for k, v in sorted(curriculum.items()) if k.endswith("_start") and f"{k.removesuffix('_start')}_end" in curriculum]
            short = {key.removeprefix("hallucinate_"): f for f, key in HALLUCINATION.items()}
            fields |= {"curriculum": tuple((short[k], a, b) for k, a, b in ramps), "curriculum_start": curriculum.get("start_epoch", 1), "curriculum_ramp": curriculum.get("ramp_epochs", 1)}
        style = "multiscale" if self.get(section, "ff_multiscale") else "layerwise" if self.get(section, "ff_layerwise") else self.get(section, "style", "e2e")
        return dataclasses.replace(jobs.Training(), style=style, hallucination=kernels.Hallucination(**own), **fields)

    def train(self) -> tuple[DataFrame, DataFrame]:
        """The model as a table, and what its epochs told."""
        graphs, c = self.build(), self.training()
        size = self.get("train", "batch_size")
        c = dataclasses.replace(c, batches=max(1, -(-graphs.count() // size))) if size else c
        said, horizon = dataclasses.asdict(c), self.get("train", "risk_horizon")

        def learnt() -> DataFrame:
            first = graphs.select(F.size(F.col("x")[0]).alias("width")).first()
            if first is None:
                raise ValueError("no window has a graph")
            targets = risk.risk_targets(graphs, self.spark.read.parquet(self.where("prices")), self.get("build_graphs", "mdy_ticker", "MDY"), horizon) if horizon else None
            layers, log = jobs.train(graphs, min(self.get("build_graphs", "window", 20), first["width"]), first["width"], c, targets)
            rows = self.spark.createDataFrame([tuple(x.values()) for x in log], jobs.LOG)
            return jobs.model_table(self.spark, layers).withColumn("kind", F.lit("model")).unionByName(rows.withColumn("kind", F.lit("log")), allowMissingColumns=True)

        both = self.table("training", learnt, ("graphs",), [said, horizon])
        return both.where("kind = 'model'").select("layer", "name", "shape", "data"), both.where("kind = 'log'").select(*[c.split()[0] for c in jobs.LOG.split(", ")])

    def report(self) -> DataFrame:
        """(horizon, decile, ..): the backtest of the model's goodness against the benchmark's risk, written as CSV as well."""
        (model, _), graphs = self.train(), self.build()
        prices, ticker = self.clean()[0], self.get("build_graphs", "mdy_ticker", "MDY")
        horizons = list(self.get("report", "horizons", [5, 20]))
        settings = [horizons, ticker, self.get("train", "goodness_temp", 1.0)]
        rows = self.table("backtest", lambda: risk.backtest(jobs.score(graphs, jobs.model_from(model), self.get("train", "goodness_temp", 1.0)), prices, ticker, horizons), ("training",), settings)
        found = self.table("quantiles", lambda: risk.goodness_quantiles(rows, horizons, self.get("report", "bins", 10)), ("backtest",), [horizons, self.get("report", "bins", 10)])
        reports.write_backtest(rows, found, f"{self.out}/report")
        return found


def run(spark: SparkSession, path: str, out: str, given: dict[str, dict] | None = None) -> tuple[DataFrame, list[str]]:
    """A report from raw files as a settings file says, and the names of the tables that were made for it; those that were there are read."""
    r = Run(spark, path, out, given)
    return r.report(), r.made
