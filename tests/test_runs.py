"""From raw CSV files to a report by a settings file, broken off once."""

import datetime

import numpy as np
import pytest

from corrweave.learn import jobs
from corrweave.plans import runs

SETTINGS = """
[clean]
prices = "{0}/prices"
constituents = "{0}/members"
fundamentals = "{0}/funds"

[clean.columns]
ticker = "Name"

[build_graphs]
window = 6
top_k = 3
corr_threshold = ""
min_nodes = 4
feature_mode = "window_plus_summary_fund"
mdy_ticker = "T0"
membership_fill = "ffill"
membership_max_gap_days = 40
include_tickers = "T0, T1"

[train]
epochs = 2
hidden_dim = 5
batch_size = 10
ff_layerwise = true
layerwise_neg_mode = "shuffle+noise"
hallucinate_steps = 2
neg_mode = "schedule"

[train.hallucinate_curriculum]
enabled = true
start_epoch = 1
ramp_epochs = 2
steps_start = 1
steps_end = 3

[report]
horizons = [2, 3]
bins = 4
"""


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(0)
    for d in ("prices/y1", "prices/y2", "members", "funds"):
        (tmp_path / d).mkdir(parents=True)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(40)]
    price = np.exp(np.cumsum(r.normal(0, 0.02, (40, 8)), axis=0)) * 50
    for part, mine in (("y1", range(20)), ("y2", range(20, 40))):
        lines = [f"{days[i]},t{t} X9,{price[i, t]},{100 + t}" for i in mine for t in range(8)]
        (tmp_path / "prices" / part / "p.csv").write_text("Date,Name,Close,Volume\n" + "\n".join(lines))
    (tmp_path / "members" / "m.csv").write_text("time,Name,member\n" + "\n".join(f"{days[i]},T{t},{int(t < 7)}" for i in (0, 20) for t in range(8)))
    (tmp_path / "funds" / "f.csv").write_text("date,ticker,pe_ratio,debt_equity\n" + "\n".join(f"{days[i]},T{t},{t},1Y:0.{t}" for i in (0, 15) for t in range(6)))
    (tmp_path / "run.toml").write_text(SETTINGS.format(tmp_path))
    return tmp_path


def test_from_raw_files_to_a_report(spark, folder, monkeypatch):
    settings, out = str(folder / "run.toml"), str(folder / "out")
    train = jobs.train
    monkeypatch.setattr(jobs, "train", lambda *a: (_ for _ in ()).throw(RuntimeError("broken off")))
    with pytest.raises(RuntimeError):
        runs.run(spark, settings, out)
    monkeypatch.setattr(jobs, "train", train)
    found, made = runs.run(spark, settings, out)
    assert made == ["training", "backtest", "quantiles"]  # what was there before the break is read
    rows = found.collect()
    assert {r.horizon for r in rows} == {2, 3} and {r.decile for r in rows} == {0, 1, 2, 3}
    assert all(r.avg_vol > 0 and r.avg_drawdown <= 0 for r in rows)
    assert len(spark.read.csv(str(folder / "out" / "report" / "quantiles"), header=True).collect()) == len(rows)
    assert runs.run(spark, settings, out)[1] == []

    r = runs.Run(spark, settings, out)
    graphs = r.build()
    stats = spark.read.parquet(r.where("build_stats")).first()
    assert stats.built == graphs.count() == 34 and stats.total_windows == 35  # the first window has a return too few
    assert {len(g.tickers) for g in graphs.collect()} == {7} and {len(x) for g in graphs.collect() for x in g.x} == {6 + 5 + 2}
    c = r.training()
    assert (c.style, c.hidden, c.layer_negative, c.curriculum, c.hallucination.steps) == ("layerwise", 5, "shuffle+noise", (("steps", 1, 3),), 2)
    _, log = r.train()
    assert [x.hallucinate_ratio for x in log.orderBy("epoch").collect()] == [0.0, 1.0]

    other = runs.Run(spark, settings, out, {"build_graphs": {"corr_threshold": 0.1}, "train": {"epochs": 1}})
    assert other.train()[1].count() == 1
    assert other.made == ["returns", "members", "windows", "status", "graphs", "build_stats", "training"]  # prices and the like stay


def test_settings_that_lack_something(spark, folder):
    settings, out = str(folder / "run.toml"), str(folder / "out")
    with pytest.raises(ValueError, match="prices"):
        runs.run(spark, settings, out, {"clean": {"prices": ""}})
    everyone = runs.Run(spark, settings, out, {"build_graphs": {"membership_mode": "all", "feature_mode": "window"}})
    assert {len(g.tickers) for g in everyone.build().collect()} == {8}
