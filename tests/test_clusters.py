"""Density clusters against a plain search that compares all alerts."""

import random

import numpy as np
import pytest

from faultline.operators import clusters
from faultline.plans.incident import ALERT_EPS, QUERIES

ALERT = "batch string, alert_id long, ord long, ts double, service string, anomaly_type string, severity string, cell string"


def plain(rows, eps, least):
    """cluster of each alert_id, of one batch."""
    rows = sorted(rows, key=lambda r: r[2])
    code = lambda k: [{v: n for n, v in enumerate(dict.fromkeys(r[k] for r in rows))}[r[k]] for r in rows]
    v = np.array([[r[3] or 0.0 for r in rows], code(4), code(5), [clusters.SEVERITY.get((r[6] or "").lower(), 1) for r in rows]], float).T
    span = v.max(0) - v.min(0)
    x = (v - v.min(0)) / np.where(span > 0, span, 1) * np.array(clusters.WEIGHTS)
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps + clusters.SLACK) for p in x]
    label, done, cluster = np.full(len(x), -1), np.zeros(len(x), bool), -1
    for i in range(len(x)):
        if done[i] or len(near[i]) < least:
            continue
        cluster += 1
        label[near[i]] = cluster
        todo = [i]
        while todo:
            j = todo.pop()
            if not done[j] and len(near[j]) >= least:
                done[j] = True
                label[near[j][label[near[j]] == -1]] = cluster
                todo += list(near[j])
    return {r[1]: int(c) for r, c in zip(rows, label, strict=True)}


@pytest.mark.parametrize(("eps", "least", "n"), [(0.5, 2, 30), (0.05, 2, 150), (0.05, 4, 150), (0.16, 5, 150), (0.21, 8, 150)])
def test_clusters_equal_the_plain_search(spark, eps, least, n):
    rng, rows = random.Random(int(eps * 100) + least), []
    for batch in ("a", None):
        for k in range(n):
            ts = rng.choice([None, rng.random() * 5, 1000.0, 300 + rng.random() * 20, rng.random() * 1000, rng.random() * 1000])
            rows.append((batch, len(rows), (k * 37) % n, ts, rng.choice(["s0", "s1", "s2", None]), rng.choice(["t0", "t1", ""]), rng.choice(["low", "HIGH", "critical", "odd", None]), "x"))
    want = plain(rows[:n], eps, least) | plain(rows[n:], eps, least)
    got = clusters.cluster_alerts(spark.createDataFrame(rows, ALERT), "batch", eps, least)
    assert got.columns[-2:] == ["cell", "cluster"]
    assert {r.alert_id: r.cluster for r in got.collect()} == want
    assert len(set(want.values())) > 2 or eps > 0.05


def test_nearest_pair_of_one_cell(spark):
    """Times of one cell, services nearly a radius apart: linked only if a pair is as near as the rest allows."""
    for near in (0.0, 0.004, 0.3):
        rows = [("a", 10 * k + j, 10 * k + j, 1.0 + near * k + 0.0001 * j, f"s{k}", "t", "low", "") for k in range(2) for j in range(4)]
        rows += [("a", 30, 30, 100.0, "s2", "t", "low", "")]
        got = {r.alert_id: r.cluster for r in clusters.cluster_alerts(spark.createDataFrame(rows, ALERT), "batch", 0.1500001, 2).collect()}
        assert got == plain(rows, 0.1500001, 2)


def test_repeated_rows_and_no_alerts(spark):
    rows = [("a", 1, 1, 5.0, "s", "t", "low", "")] * 3 + [("a", 2, 2, 900.0, "s", "t", "low", "")]
    df = spark.createDataFrame(rows, ALERT)
    assert sorted((r.alert_id, r.cluster) for r in clusters.cluster_alerts(df, "batch", 0.1, 3).collect()) == [(1, 0)] * 3 + [(2, -1)]
    assert clusters.cluster_alerts(df.limit(0), "batch").collect() == []
    with pytest.raises(ValueError, match="eps"):
        clusters.cluster_alerts(df, "batch", 0.001)


def test_query_takes_every_error(spark, data):
    kinds = {r.event_id: r for r in spark.read.parquet(f"{data}/events.parquet").filter("event_type = 'error'").selectExpr("*", "unix_micros(timestamp(ts)) div 1000000 as s").collect()}
    grade = lambda v: "critical" if v > 120 else "high" if v > 60 else "medium" if v > 20 else "low"
    rows = [("", r.event_id, r.event_id, float(r.s), f"svc{r.user_id % 8}", "latency" if r.value > 100 else "http_error", grade(r.value)) for r in kinds.values()]
    want = plain(rows, ALERT_EPS, 2)
    sizes = {c: sum(v == c for v in want.values()) for c in set(want.values()) - {-1}}
    assert {r.cluster: r["size"] for r in QUERIES["dbscan_alerts"](spark, data).collect()} == sizes
