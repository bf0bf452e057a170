"""A sweep learns from and is tested on all graphs."""

import dataclasses
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrweave.learn import jobs, kernels
from corrweave.operators import trials


def test_sweep_uses_all_graphs(spark):
    r, rows = np.random.default_rng(3), []
    for i in range(100):
        x = (r.normal(size=(4, 6)) * (1 + i / 20)).tolist()
        rows.append((datetime.date(2020, 1, 1) + datetime.timedelta(i), list("abcd"), x, [0, 1, 2, 3], [1, 2, 3, 0], [0.5] * 4, [1.0] * 4, [0.0] * 4, [1.0] * 4))
    packed = spark.createDataFrame(rows, jobs.PACKED).cache()
    grid = spark.createDataFrame([(0, 7, "e2e", 4), (1, 8, "layerwise", 3)], "trial_id int, seed int, mode string, hidden int")
    base = jobs.Training(epochs=2)
    got = {x.trial_id: x for x in jobs.run_trials(grid, packed, 6, base).collect()}
    parts = packed.join(trials.split(packed.select("date"), key="date"), "date").cache()
    assert parts.where("part = 'train'").count() == 80
    for t in grid.collect():
        c = dataclasses.replace(base, style=t.mode, seed=t.seed, hidden=t.hidden)
        layers, _ = jobs.train(parts.where("part = 'train'").drop("part"), 6, 6, c)
        want = jobs.score(parts.where("part = 'eval'").drop("part"), layers, c.temperature).agg(F.avg("goodness")).first()[0]
        assert np.isclose(got[t.trial_id].eval_g_pos, want)
        assert np.isclose(got[t.trial_id].eval_sep, got[t.trial_id].eval_g_pos - got[t.trial_id].eval_g_neg)
        assert 0 <= got[t.trial_id].eval_acc <= 1


def packed_graphs(spark, n=40):
    r, rows = np.random.default_rng(3), []
    for i in range(n):
        x = (r.normal(size=(4, 6)) * (1 + i / 10)).tolist()
        rows.append((datetime.date(2020, 1, 1) + datetime.timedelta(i), list("abcd"), x, [0, 1, 2, 3], [1, 2, 3, 0], [0.5] * 4, [1.0] * 4, [0.0] * 4, [1.0] * 4))
    return spark.createDataFrame(rows, jobs.PACKED)


def test_risk_head_learns(spark):
    packed = packed_graphs(spark)
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(i), i / 20 - 1.0) for i in range(36)] + [(datetime.date(2020, 1, 1) + datetime.timedelta(i), v) for i, v in ((36, None), (37, float("nan")))]
    targets = spark.createDataFrame(rows, "date date, target double")
    c = jobs.Training(hidden=4, epochs=12, lr=0.05, risk_weight=1.0)
    _, head, log = jobs.train_with_head(packed, 6, 6, c, targets)
    assert log[-1]["risk_loss"] < log[0]["risk_loss"] and np.abs(head).max() > 0
    assert all(x["risk_loss"] is None for x in jobs.train(packed, 6, 6, dataclasses.replace(c, style="layerwise", epochs=1), targets)[1])


def plain_layerwise(graphs, c, window, epochs):
    """Layer by layer as one reads it: forward, a negative of the layer's input, its loss, its step; then on with the output from before the step."""
    layers = kernels.new_layers(6, c.hidden, c.layers, c.seed)
    adams, log = [kernels.Adam(c.lr) for _ in layers], []
    for epoch in range(1, epochs + 1):
        rngs = {d: np.random.default_rng([c.seed * 1000 + epoch, d.toordinal()]) for d in graphs}
        modes = {d: c.mode(epoch, rngs[d]) for d in graphs}
        now, losses = {d: g.x for d, g in graphs.items()}, []
        for i in range(len(layers)):
            grads, after = [], {}
            for d, g in graphs.items():
                x, layer = now[d], [layers[i]]
                if modes[d] == "hallucinate":
                    bad = kernels.hallucinate(layer, g.with_x(x), c.at_layer(epoch), rngs[d])
                else:
                    bad = kernels.negative(x, c.layer_negative, window, c.layer_noise, rngs[d])
                told, grad = kernels.layerwise_step(layer, g.with_x(x), lambda _, x, bad=bad: bad, c.target, c.temperature)
                losses.append(told[0])
                grads.append(grad[0])
                after[d] = kernels.forward(layer, g, x)[0][1]
            [(dw, db)] = kernels.clipped([tuple(np.mean([g[j] for g in grads], axis=0) for j in (0, 1))], c.clip)
            adams[i].t += 1
            layers[i] = (adams[i].step("w", layers[i][0], dw), adams[i].step("b", layers[i][1], db))
            now = after
        log.append(np.mean(losses))
    return layers, log


@pytest.mark.parametrize("negative", ["shuffle", "schedule"])
def test_layerwise_training_is_the_plain_one(spark, negative):
    """A graph's draws come from a generator of its own, layer after layer, so that both see the same."""
    packed = packed_graphs(spark, 12)
    c = jobs.Training(style="layerwise", hidden=5, layers=3, epochs=3, negative=negative, layer_negative="shuffle+noise", layer_noise=0.1, layer_corr=0.2, layer_std=0.01)
    layers, log = jobs.train(packed, 6, 6, c)
    graphs = {r.date: kernels.Graph(np.array(r.x), np.array(r.src), np.array(r.dst), np.array(r.corr), np.array(r.weight)) for r in packed.collect()}
    want, losses = plain_layerwise(graphs, c, 6, 3)
    assert all(np.allclose(a, b) for x, y in zip(layers, want) for a, b in zip(x, y))
    assert np.allclose([x["loss"] for x in log], losses)
    assert [x["hallucinate_ratio"] for x in log] == ([0, 0, 0] if negative == "shuffle" else [0, 1, 1])


def test_all_plans_learn_in_as_many_jobs_as_one(spark):
    packed = packed_graphs(spark).cache()
    plans = [jobs.Training(style=s, hidden=h, epochs=e, batches=b, negative=n, gate_margin=m, energy=0.1) for s, h, e, b, n, m in (("e2e", 4, 3, 1, "mix", 0.1), ("layerwise", 3, 2, 2, "shuffle", None), ("multiscale", 5, 2, 3, "hallucinate", 0.0), ("backprop", 4, 1, 1, "noise", None))]
    context = spark.sparkContext
    context.setJobGroup("sweep", "all")
    together = jobs.train_all(packed, 6, 6, plans)
    ran = len(context.statusTracker().getJobIdsForGroup("sweep"))
    context.setJobGroup("one", "longest")
    jobs.train_all(packed, 6, 6, plans[2:3])
    assert ran <= len(context.statusTracker().getJobIdsForGroup("one")) + 1
    context.setLocalProperty("spark.jobGroup.id", None)
    for c, (layers, head, log, took) in zip(plans, together):
        alone, head_alone, log_alone = jobs.train_with_head(packed, 6, 6, c)
        assert all(np.allclose(a, b) for x, y in zip(layers, alone) for a, b in zip(x, y)) and np.allclose(head, head_alone)
        assert len(log) == c.epochs and all(np.isclose(a[k], b[k]) for a, b in zip(log, log_alone) for k in a if a[k] is not None)
        assert [n for _, n in took] == [40] * c.epochs
    assert together[2][2][0]["gate_ratio"] > 0 and together[0][2][0]["energy_penalty"] > 0


def test_curriculum_and_mix():
    c = jobs.Training(curriculum=(("steps", 1, 4), ("node_fraction", 0.5, 1.5), ("lr", 0.1, 0.2)), curriculum_start=2, curriculum_ramp=4, warmup=1, mix_start=0.2, mix_end=0.6, ramp=4)
    assert [c.at(e).steps for e in (1, 2, 4, 6, 9)] == [1, 1, 2, 4, 4]
    assert c.at(9).node_fraction == 1.0 and np.isclose(c.at(4).lr, 0.15)
    assert np.allclose([c.hallucinated(e) for e in (1, 3, 5, 9)], [0, 0.4, 0.6, 0.6])


def test_benchmark_of_styles(spark):
    rows = {r["mode"]: r for r in jobs.benchmark(packed_graphs(spark), 6, 6, jobs.Training(hidden=4, epochs=2)).collect()}
    assert set(rows) == {"layerwise", "e2e", "backprop"}
    assert all(r.graphs_per_s > 0 and 0 <= r.eval_acc <= 1 and np.isclose(r.eval_sep, r.eval_g_pos - r.eval_g_neg) for r in rows.values())
    assert [m for m, r in rows.items() if r.eval_bce is not None] == ["backprop"]
