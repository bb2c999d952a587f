"""The sequence model against a step-by-step form, searches by several texts, issue edges and sources."""

import json
import math

import numpy as np
import pytest

from faultline.operators import graph, models, retrieval, sequences
from faultline.sources import stores


@pytest.fixture(scope="module")
def model():
    return sequences.default_coder()


def slow_errors(model, steps):
    """Errors of one sequence, number by number."""
    gate = lambda z: 1 / (1 + math.exp(-max(-20.0, min(20.0, z))))

    def step(w, x, h, c):
        size, x = len(h), [*x, *h]
        z = [sum(a * w[i][j] for i, a in enumerate(x)) for j in range(4 * size)]
        c = [gate(z[k]) * c[k] + gate(z[size + k]) * math.tanh(z[3 * size + k]) for k in range(size)]
        return [gate(z[2 * size + k]) * math.tanh(c[k]) for k in range(size)], c

    zero = [0.0] * model.hidden
    h, c = zero, zero
    for x in steps:
        h, c = step(model.encoder.w, x, h, c)
    code, c, out = h, zero, []
    for x in steps:
        h, c = step(model.decoder.w, code, h, c)
        y = [sum(h[k] * model.w[k][f] for k in range(model.hidden)) + model.b[f] for f in range(len(x))]
        out.append(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) / len(x))
    return out


def rows_of(name, x):
    return [(name, t, *map(float, v)) for t, v in enumerate(x)]


SCHEMA = "service string, at int, " + ", ".join(f"{f} double" for f in models.FEATURES)


def test_scores_equal_the_slow_form(spark, model):
    rng = np.random.RandomState(5)
    given = {f"s{k}": rng.rand(k + 1, 6) for k in range(7)} | {"long": rng.rand(300, 6)}
    rows = [r for name, x in given.items() for r in rows_of(name, x)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0], int(r[1]), *map(float, r[2:])) for r in rows], SCHEMA)
    got = {r.service: r for r in sequences.sequence_scores(df, ["service"], "at", model).collect()}
    assert set(got) == set(given)
    for name, x in given.items():
        local = slow_errors(model, x.tolist())
        r = got[name]
        assert r.n == len(x) and r.error == pytest.approx(np.mean(local), rel=1e-9)
        assert r.far_steps == [t for t, e in enumerate(local) if e > np.mean(local) + np.std(local)]
        want = np.polyfit(np.arange(len(x)), x, 1)[0] if len(x) > 1 else np.zeros(6)
        assert [r[f"{f}_slope"] for f in models.FEATURES] == pytest.approx(want.tolist(), abs=1e-9)
        swings = len(x) > 2 and any(np.abs(np.diff(x[:, k])).std() > 0.15 for k in range(3))
        assert r.trend == ("degrading" if r.ramp else "oscillating" if swings else "stable")


def test_verdicts(spark, model):
    t = np.arange(10)[:, None]
    healthy = sequences.healthy_sequences(20, seed=9)
    ramp = np.clip(np.hstack([0.3 + 0.05 * t, 0.02 + 0.08 * t, 0.2 + 0.08 * t, 0.9 - 0.08 * t, 0.4 + 0 * t, 0.2 + 0.08 * t]), 0, 1)
    df = spark.createDataFrame([r for k, x in enumerate(healthy) for r in rows_of(f"h{k}", x)] + rows_of("ramp", ramp), SCHEMA)
    got = {r.service: r for r in sequences.sequence_scores(df, ["service"], "at", model).collect()}
    assert got["ramp"].ramp and got["ramp"].trend == "degrading"
    assert sum(got[f"h{k}"].is_anomaly for k in range(20)) <= 4
    assert all(r.is_anomaly == (r.error > model.threshold) for r in got.values())


def test_gradient_and_training(model):
    x = sequences.healthy_sequences(30)
    again = sequences.SequenceCoder(x, epochs=30)
    assert np.mean(again.losses[-5:]) < np.mean(again.losses[:5])
    fresh = sequences.SequenceCoder(x[:1], epochs=0)
    states = fresh.states(x[:1])[0]
    before = fresh.w.copy(), fresh.b.copy()
    loss = lambda w, b: float(((states @ w + b - x[0]) ** 2).mean())
    fresh._train(fresh.states(x[:1]), x[:1], np.random.RandomState(0), 0.001, 0.9, 10)
    e = np.zeros_like(before[0])
    for at in ((0, 0), (3, 2), (7, 5)):
        e[:] = 0
        e[at] = 1e-3
        slope = (loss(before[0] + e, before[1]) - loss(before[0] - e, before[1])) / 2e-3
        assert (fresh.w - before[0])[at] == pytest.approx(-0.001 * slope, rel=1e-6, abs=1e-15)
    assert sequences.SequenceCoder(x[:0]).threshold == 0.0


def test_sequence_edge_cases(spark, model):
    none = spark.createDataFrame([], SCHEMA)
    assert sequences.sequence_scores(none, ["service"], "at", model).count() == 0
    odd = spark.createDataFrame([(None, 1, None, 0.1), (None, 1, None, 0.1), ("a", None, 0.5, None)], "service string, at int, cpu_pct double, steps double")
    got = {r.service: r for r in sequences.sequence_scores(odd, ["service"], "at", model).collect()}
    assert got[None].n == 2 and got["a"].n == 1 and got["a"].trend == "stable"
    assert got[None].error == pytest.approx(np.mean(slow_errors(model, [[0.0] * 6] * 2)))
    assert got["a"].error == pytest.approx(slow_errors(model, [[0.5, 0, 0, 0, 0, 0]])[0])


def test_best_of_searches(spark):
    rng = np.random.RandomState(2)
    rows = [(int(q), int(d), float(round(rng.rand(), 1))) for q in range(6) for d in rng.choice(60, 40, replace=False)]
    best = {}
    for q in range(6):
        for _, d, s in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:10]:
            if d not in best or s > best[d][1]:
                best[d] = (q, s)
    want = [(d, q, s) for d, (q, s) in sorted(best.items(), key=lambda x: (-x[1][1], x[0]))[:5]]
    got = retrieval.best_of_searches(spark.createDataFrame(rows, "q int, d int, s double"), "d", "q", "s")
    assert [(r.d, r.q, r.s) for r in got.collect()] == want


def test_issue_edges(spark):
    rows = [("a", "b", "TypeError"), ("a", "b", None), ("b", "", "error"), (None, "c", "error"), ("b", "c", "style")]
    got = {(r.src, r.dst): (r.weight, r.call_type) for r in graph.issue_edges(spark.createDataFrame(rows, "s string, c string, k string"), "s", "c", "k").collect()}
    assert got == {("a", "b"): (3.0, "rpc"), ("b", "c"): (1.0, "rpc")}


def test_comment_pages_and_bodies(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps([{"id": 1, "created_at": "2024-01-01", "body": "a\nb"}, {"id": 2, "body": None}]))
    (pages / "2.json").write_text(json.dumps([{"id": 3, "created_at": "2024-01-02", "body": "c", "user": {"x": 1}}]))
    assert sorted((r.id, r.body) for r in stores.read_comments(spark, str(pages)).collect()) == [(1, "a\nb"), (2, None), (3, "c")]
    bodies = tmp_path / "bodies"
    bodies.mkdir()
    (bodies / "x.md").write_text("line 1\nline é")
    (bodies / "y.md").write_bytes(b"\xff\xfe")
    (bodies / "z.md").write_text("")
    assert sorted(r.body for r in stores.read_bodies(spark, str(bodies)).collect()) == ["", "line 1\nline é"]
