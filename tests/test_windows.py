"""Invariants of the window selector, documents of a corpus, and lists re-ranked by their own statistics."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import benchmark, retrieval, windows
from faultline.sources import corpus

DAY = 1_700_000_000 // 86400 * 86400
SIGNALS = "incident_id int, kind string, t double, t_end double, severity string, magnitude double"


def best(spark, signals, incidents=None, lookback=43_200):
    """Rows of the best windows and of the coverage, by incident."""
    ids = sorted({s[0] for s in signals}) if incidents is None else incidents
    i = spark.createDataFrame([(k, DAY + 43_200, lookback) for k in ids], "incident_id int, reported_at long, lookback long")
    s = spark.createDataFrame(signals, SIGNALS)
    w = windows.located(s, i)
    rows = {}
    for r in w.orderBy("incident_id", "rank").collect():
        rows.setdefault(r.incident_id, []).append(r)
    return rows, {r.incident_id: r for r in windows.coverage(w, s, i).collect()}


def vendor(i, hour, severity, minutes=30):
    return (i, "vendor", float(DAY + 3600 * hour), float(DAY + 3600 * hour + 60 * minutes), severity, None)


def point(i, kind, hour, magnitude=None):
    return (i, kind, float(DAY + 3600 * hour), None, None, magnitude)


def test_no_evidence_says_so_and_stops(spark):
    rows, cover = best(spark, [point(1, "page", 30), (2, "vendor", None, None, "HIGH", None), vendor(3, 5, "WHATEVER"), vendor(4, 5, "LOW")], [0, 1, 2, 3, 4])
    assert set(rows) == {4}
    for k in range(4):
        assert (cover[k].coverage_warning, cover[k].confidence, cover[k].stop) == ("no_evidence_available", 0.0, True)
    assert cover[4].coverage_warning is None and cover[4].stop and 0.3 < cover[4].confidence < 0.4  # one low anomaly is not enough
    assert [cover[k].pages_missing for k in range(5)] == [True, False, True, True, True]


def test_severity_goes_before_nearness(spark):
    rows, _ = best(spark, [vendor(1, 2, "CRITICAL"), vendor(1, 11, "LOW"), vendor(2, 2, "critical"), vendor(2, 11, "MEDIUM"), vendor(3, 2, "HIGH"), vendor(3, 11, "LOW")])
    for k in (1, 2, 3):
        assert rows[k][0].start <= DAY + 7200 <= rows[k][0].end and rows[k][0].confidence > rows[k][1].confidence


def test_more_evidence_never_lowers_a_confidence(spark):
    rng = random.Random(11)
    signals = []
    for k in range(60):
        own = [point(2 * k, rng.choice(("deploy", "page", "change")), rng.uniform(1, 11), rng.uniform(-40, 40)) for _ in range(rng.randint(1, 5))]
        more = [vendor(2 * k, rng.uniform(1, 11), rng.choice(list(windows.SEVERITY)), rng.randint(1, 200)) for _ in range(rng.randint(1, 3))]
        signals += own + [(2 * k + 1, *s[1:]) for s in own + more]
    rows, cover = best(spark, signals)
    for k in range(60):
        assert rows[2 * k + 1][0].confidence >= rows[2 * k][0].confidence
    for i, found in rows.items():
        assert 1 <= len(found) <= 3 and [r.rank for r in found] == list(range(1, len(found) + 1))
        assert all(a.confidence >= b.confidence for a, b in zip(found, found[1:], strict=False))
        assert all(abs(a.start - b.start) >= 1800 for n, a in enumerate(found) for b in found[n + 1 :])
        assert all(r.end - r.start == 1800 and r.start % 300 == 0 and r.end <= DAY + 43_200 and r.start >= DAY for r in found)
        assert cover[i].stop == (found[0].confidence < 0.4)


def test_ceiling_without_pages_and_its_end(spark):
    strong = [vendor(1, 5, "CRITICAL"), vendor(1, 5, "CRITICAL"), point(1, "deploy", 4.9)]
    rows, cover = best(spark, strong + [(2, *s[1:]) for s in strong] + [point(2, "page", 5.1)])
    assert rows[1][0].confidence == 0.8 and cover[1].pages_missing
    assert rows[2][0].confidence > 0.8 and not cover[2].pages_missing and rows[2][0].n_page == 1 and rows[2][0].n_vendor == 2


def test_magnitude_counts_up_to_twenty_sigma(spark):
    rows, _ = best(spark, [point(k, "change", 5, m) for k, m in enumerate((1.0, 19.0, 20.0, 400.0, -400.0))])
    c = [rows[k][0].confidence for k in range(5)]
    assert c[0] < c[1] < c[2] == c[3] == c[4] == round(1 - math.exp(-1.0), 6)


def test_width_grows_with_the_span_up_to_25_minutes(spark):
    # half an hour before the anomaly's start, as far as its left side reaches
    signals = [vendor(k, 5, "HIGH", m) for k, m in enumerate((1, 20, 40, 50, 500))]
    out = windows.evidence_of(spark.createDataFrame(signals, SIGNALS)).orderBy("incident_id").collect()
    assert [r.s_left / 60 for r in out] == [10, 10, 20, 25, 25] and {r.s_right for r in out} == {300.0}


@pytest.mark.parametrize("text, spans", [
    ("slow since this morning", [(6, 12)]), ("it broke at 2pm", [(13.5, 14.5)]), ("AT 11:30 AM and after lunch", [(12, 15), (11, 12)]), ("at 12am", [(-0.5, 0.5)]), ("last night", [(-6, 0)]), ("nothing", []), (None, []),
])
def test_times_in_tickets(spark, text, spans):
    df = spark.createDataFrame([(text, DAY + 50_000)], "t string, at long")
    got = df.select(windows.text_ranges(F.col("t"), F.col("at")).alias("r")).first().r
    assert [((x.t - DAY) / 3600, (x.t_end - DAY) / 3600) for x in got] == spans


def document(**change):
    d = {"incident_id": "I", "ground_truth": {"start": "2026-03-14T14:05:00Z", "end": "2026-03-14T16:35:00+02:00"}, "ticket": {"title": "down", "reported_at": "2026-03-14T14:50:00"}}
    return json.dumps({k: v for k, v in (d | change).items() if v != "gone"}, indent=1)


def test_corpus_says_what_is_unusable(spark, tmp_path):
    files = {
        "a.json": document(), "b.json": document()[:40], "c.json": document(ticket="gone", ground_truth="gone"), "d.json": document(ground_truth={"start": "x"}), "e.json": "[]", "f.json": document(ground_truth=None),
        "g.json": document(ticket=None), "h.json": "", "i.txt": document(), "j.json": document(ground_truth={"start": None, "end": None}),
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    rows = corpus.load_corpus(spark, str(tmp_path))
    reasons = {r.file: r.reason for r in rows.collect()}
    every = "missing fields: incident_id, ground_truth, ticket"
    assert reasons == {
        "a.json": None, "b.json": "invalid JSON", "c.json": "missing fields: ground_truth, ticket", "d.json": "ground_truth missing start/end", "e.json": every, "f.json": "ground_truth missing start/end",
        "g.json": None, "j.json": None,
    }
    a = corpus.postmortems(rows).filter("truth_start is not null").orderBy("reported_at", ascending=False).first()
    assert (a.truth_end - a.truth_start, a.reported_at - a.truth_start, a.lookback) == (1800, 2700, 86_400)
    assert spark.range(1).select(corpus.iso(F.lit(int(a.truth_start)))).first()[0] == "2026-03-14T14:05:00Z"


def test_benchmark_with_metrics(spark, tmp_path):
    minute = lambda k: f"2026-03-14T{k // 60:02d}:{k % 60:02d}:00Z"
    quiet = [{"t": minute(5 * k), "v": 0.01} for k in range(120)]
    points = quiet + [{"t": minute(600 + 5 * k), "v": 0.9} for k in range(3)]
    body = document(ground_truth={"start": minute(595), "end": minute(625)}, ticket={"reported_at": minute(700)}, metrics={"web": {"error_rate": points, "p99": quiet[:2]}}, pages=[{"paged_at": minute(605)}])
    (tmp_path / "a.json").write_text(body)
    cases = corpus.postmortems(corpus.load_corpus(spark, str(tmp_path)))
    changes = benchmark.change_points(cases).collect()
    assert changes and all(r.kind == "change" and r.magnitude > 3 for r in changes)
    board = {r.strategy: r for r in benchmark.benchmark(cases).collect()}
    assert set(board) == {"naive_page", "naive_deploy", "vendor_only", "selector", "selector_no_vendor"}
    assert board["selector"].hit_rate == board["selector_no_vendor"].hit_rate == board["naive_page"].hit_rate == 1.0
    assert board["vendor_only"].applicable == board["naive_deploy"].applicable == 0


def test_rerank_counts_within_each_list(spark):
    candidates = [(1, 10, "inventory reserve fails"), (1, 11, "reserve reserve"), (1, 12, None), (2, 10, "inventory reserve fails"), (2, 13, "inventory"), (2, 14, "inventory count"), (3, 10, "x")]
    asked = [(1, "reserve inventory reserve"), (2, "reserve inventory"), (3, ""), (4, "no candidates")]
    out = retrieval.rerank(spark.createDataFrame(candidates, "q int, d int, text string"), spark.createDataFrame(asked, "q int, text string"), "d", "q", k=2).orderBy("q", "rank").collect()

    def score(words, lists):
        n, mean = len(lists), sum(map(len, lists)) / len(lists)
        one = lambda w, d: math.log((n - sum(w in x for x in lists) + 0.5) / (sum(w in x for x in lists) + 0.5) + 1) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean))
        return [sum(one(w, d) for w in words) for d in lists]

    first = score(["reserve", "inventory"], [["inventory", "reserve", "fails"], ["reserve", "reserve"], []])
    assert [(r.q, r.d, r["rank"]) for r in out] == [(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 13, 2)]
    assert out[0].score == pytest.approx(first[0]) and out[1].score == pytest.approx(first[1])
    assert out[0].terms == ["reserve", "inventory", "reserve"] and out[1].terms == ["reserve", "reserve"] and out[3].terms == ["inventory"]
