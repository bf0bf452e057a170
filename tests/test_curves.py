"""A sweep's scatter, a training's curves, and a scenario book's controller."""

import dataclasses

import pytest

from corrweave.learn.jobs import Controller
from corrweave.learn.kernels import Hallucination
from corrweave.operators import trials


def test_tradeoff_marks_the_frontier(spark):
    rows = [(1, "a", 1.0, 0.5), (2, "a", 1.0, 0.5), (3, "b", 2.0, 0.4), (4, "b", 3.0, 0.9), (5, "b", None, 2.0), (6, "a", 4.0, None), (7, "a", 5.0, 0.9)]
    df = spark.createDataFrame(rows, "trial_id int, mode string, speed double, sep double")
    found = {r.trial_id: r.on_frontier for r in trials.tradeoff(df, "speed", "sep").collect()}
    assert found == {1: True, 2: False, 3: False, 4: True, 7: False}
    assert {r.trial_id for r in trials.frontier_prefix_max(df, "speed", "sep").collect()} == {k for k, on in found.items() if on}
    assert trials.tradeoff(df.limit(0), "speed", "sep").count() == 0


def test_training_curves(spark):
    df = spark.createDataFrame([("x", 1, 4.0, None), ("x", 1, 2.0, 1.0), ("y", 1, 9.0, None), ("x", 2, 1.0, None)], "mode string, epoch int, loss double, g_pos double")
    found = {(r.epoch, r.series): (r["mean"], r.lowest, r.highest, r.n) for r in trials.training_curves(df, ["loss", "g_pos", "gate_ratio"]).collect()}
    assert found == {(1, "loss"): (5.0, 2.0, 9.0, 3), (1, "g_pos"): (1.0, 1.0, 1.0, 1), (2, "loss"): (1.0, 1.0, 1.0, 1)}
    each = {(r.mode, r.epoch, r.series): r["mean"] for r in trials.training_curves(df, ["loss"], ["mode"]).collect()}
    assert each == {("x", 1, "loss"): 3.0, ("y", 1, "loss"): 9.0, ("x", 2, "loss"): 1.0}
    with pytest.raises(ValueError, match="gate_ratio"):
        trials.training_curves(df, ["gate_ratio"])


def test_controller_moves_and_holds():
    c, h = Controller(), Hallucination()
    weight, freer = c.moved(10.0, h, 0.2, 0.01)
    assert weight == 15.0 and freer.steps == 15 and freer.lr == pytest.approx(0.12) and freer.l2_weight == pytest.approx(0.08) and freer.corr_weight == pytest.approx(0.8)
    assert freer.clamp_std == 3.5 and freer.node_fraction == 1.0
    weight, tighter = c.moved(10.0, h, -0.2, 0.01)
    assert weight == pytest.approx(10 / 1.5) and tighter.steps == 5 and tighter.l2_weight == pytest.approx(0.125) and tighter.corr_weight == 1.0 and tighter.node_fraction == 0.9
    assert c.moved(10.0, h, 0.005, 0.01) == (10.0, dataclasses.replace(h, steps=11, lr=0.1 * 1.05))
    at, config = 10.0, h
    for _ in range(40):
        at, config = c.moved(at, config, 0.2, 0.01)
    assert c.moved(at, config, 0.2, 0.01) == (at, config) and at == 1000.0 and config.steps == 60 and config.clamp_std == 6.0
    assert Controller(weight_factor=3.0, steps=1).moved(10.0, h, 1.0, 0.01)[0] == 30.0
