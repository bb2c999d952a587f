"""Texts of metrics, traces, evidence, checkpoints and orders against plain Python and known answers."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faultline.functions import metrics, text
from faultline.operators import checked, checkout, models, timeseries, traces
from faultline.sources import checkpoints, stores


def one(spark, value, kind="string"):
    return spark.createDataFrame([(1, value)], f"k int, v {kind}")


def test_metric_texts(spark):
    apm = "python-service\nCPU: 35% → 98%\nerror rate: 0.5 → 45%\nlatency p99: 120 ms → 4800 ms\n\njava\nmemory usage: 150\nrps: 4000\ndb query time: 30 ms"
    rows = {(r.block, r.label): r for r in metrics.text_snapshots(one(spark, apm), "v").collect()}
    assert set(rows) == {(0, "baseline"), (0, "incident"), (1, "baseline")}
    a, b, c = rows[0, "baseline"], rows[0, "incident"], rows[1, "baseline"]
    assert (a.cpu_pct, a.error_rate, a.latency_p99, a.mem_pct) == (0.35, 0.005, 0.024, 0.0)
    assert (b.cpu_pct, b.error_rate, b.latency_p99) == (0.98, 0.45, 0.96)
    assert (c.mem_pct, c.throughput, c.db_query_ms, c.cpu_pct) == (1.0, 1.0, 0.01, 0.0)
    for empty in (None, "", "nothing", "cpu: 5\nmem: 6"):
        assert metrics.text_snapshots(one(spark, empty), "v").count() == 0
    assert metrics.filled(one(spark, None, "double"), ["v", "w"]).first()[1:] == (0.0, 0.0)


def test_nested_scrub_keeps_keys_and_other_values(spark):
    data = {"alice@example.com": "value", "logs": [{"message": 'user "a\\b" alice@example.com é\n', "level": "ERROR"}, ["10.0.0.5", None, True, 3.5e7]], "n": 4111111111111111, "deep": {"a": {"b": "bob@example.com carol@example.com"}}}
    row = text.scrub_json(one(spark, json.dumps(data)), "v").first()
    want = json.loads(json.dumps(data).replace('alice@example.com \\u00e9', "<EMAIL> \\u00e9").replace("10.0.0.5", "<IP>").replace("bob@example.com carol@example.com", "<EMAIL> <EMAIL>"))
    assert json.loads(row.v) == want and row.n_emails == 3 and row.n_ips == 1 and row.n_credit_cards == 0
    assert text.scrub_json(one(spark, "mail a@b.cc"), "v").first().v == "mail <EMAIL>" and text.scrub_json(one(spark, None), "v").first().v == ""
    value = stores.json_or_text(F.col("v"))
    got = [one(spark, x).select(value[0].alias("j"), F.to_json(value[1]).alias("v")).first() for x in ('{"a": 1}', 'no "json"')]
    assert (got[0].j, json.loads(got[0].v)) == (True, {"a": 1}) and (got[1].j, json.loads(got[1].v)) == (False, 'no "json"')


def test_traces_by_indentation(spark):
    lines = ["Span 1 | api | GET /x(a) | 100ms | OK", "  └─ Span 2 | java | call() | 90ms | OK → stored 3 expected 4", "    └─ Span 3 | db | q | 10ms | ERROR → HTTP 500", "  └─ Span 4 | node | n | 5ms | TIMEOUT", "no span", "Span 5 | late | l | 1ms | OK"]
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(lines)], "trace string, no int, line string")
    rows = sorted(traces.parsed_traces(df, "trace", "no", "line").withColumn("silent", traces.is_silent(F.col("status"), F.col("detail"))).collect(), key=lambda r: r.span_id)
    assert [r.parent_id for r in rows] == [None, 0, 1, 0, None] and [r.silent for r in rows] == [False, True, False, False, False]
    assert rows[2].http_status == 500 and rows[0].operation == "GET /x"


def test_checkpoint_files(spark, tmp_path):
    path = f"file://{tmp_path}/cp"
    phases = spark.createDataFrame([("A", "intake", '{"x": [1, 2]}', None, 1), ("A", "signals", '"s"', "stage", 2), ("B", "intake", None, None, 1)], "incident_id string, phase string, output string, rca_stage string, seq int")
    now = F.lit("2024-01-01T00:00:00Z")
    assert checkpoints.write_checkpoints(checkpoints.merged(None, phases, now), path) == 2
    for name, body in (("C", "{torn"), ("D", "[]"), ("E", '{"format_version": 999, "incident_id": "E"}'), ("F", '{"format_version": 1, "incident_id": "A"}')):
        (tmp_path / "cp" / f"{name}.json").write_text(body)
    found = {r.incident_id: r for r in checkpoints.read_checkpoints(spark, path).collect()}
    assert set(found) == {"A", "B"} and json.loads(found["A"].phase_outputs["intake"]) == {"x": [1, 2]} and found["A"].last_completed_phase == "signals"
    again = spark.createDataFrame([("A", "intake", "7", "other", 9)], phases.schema)
    later = checkpoints.merged(checkpoints.read_checkpoints(spark, path), again, F.lit("2024-02-02T00:00:00Z"))
    a = later.filter("incident_id = 'A'").first()
    assert a.phase_outputs["intake"] == "7" and a.last_completed_phase == "intake" and a.rca_stage == "stage" and a.started_at < a.updated_at
    b = later.filter("incident_id = 'B'").first()
    assert b.updated_at == b.started_at
    gone = {r.incident_id: r.existed for r in checkpoints.clear_checkpoints(spark.createDataFrame([("A",), ("Z",)], "incident_id string"), path).collect()}
    assert gone == {"A": True, "Z": False} and not (tmp_path / "cp" / "A.json").exists() and not list((tmp_path / "cp").glob(".*tmp"))
    with pytest.raises(PySparkException, match="unknown phase"):
        checkpoints.merged(None, spark.createDataFrame([("A", "lunch", "1", None, 1)], phases.schema), now).collect()


def test_updates_without_a_record_fail(spark):
    r = spark.createDataFrame([("A", "worked", None)], "incident_id string, fix_outcome string, updated_at long")
    new = lambda i, o: spark.createDataFrame([(i, o, 5)], r.schema)
    assert checked.updated_outcomes(r, new("A", "partial"), "incident_id").first()[1:] == ("partial", 5)
    for i, o, said in (("B", "partial", "no learning record"), ("A", "great", "must be one of")):
        with pytest.raises(PySparkException, match=said):
            checked.updated_outcomes(r, new(i, o), "incident_id").collect()
    with pytest.raises(PySparkException, match="is empty"):
        checked.strict(r, checked.record_errors(F.lit("code"), F.lit(None), F.lit(None), F.lit(" "))).collect()


def test_checkout_against_plain_python(spark):
    import random

    rng = random.Random(3)
    coupons = [("TEN", "FIXED", 10.0, 50.0, True), ("HALF", "PERCENTAGE", 50.0, 0.0, True), ("OFF", "PERCENTAGE", 10.0, 0.0, False)]
    rows = [(k, k // 2, k % 7, rng.choice(["A", "B", "", None, "X"]), rng.choice([0, 1, 2, 5]), rng.choice([20.0, 33.33, -4.0]), rng.choice(["USD", "EUR"]), rng.choice(["TEN", "HALF", "OFF", "NO", None, " "]), rng.choice([None, f"k{k // 6}", "old"])) for k in range(300)]
    schema = "request_id int, at int, customer_id int, sku string, quantity int, unit_price double, currency string, coupon_code string, idempotency_key string"
    stock, old = {"A": 60, "B": 40}, [("order-old", 7.5, "old")]
    out = checkout.checkout(spark.createDataFrame(rows, schema), spark.createDataFrame(coupons, "code string, kind string, value double, minimum double, active boolean"), spark.createDataFrame(list(stock.items()), "sku string, qty int"), spark.createDataFrame(old, "order_id string, total double, idempotency_key string"))
    got = {r.request_id: r for r in out.collect()}
    left, known = dict(stock), {}
    for k, _, _, sku, q, price, cur, code, key in rows:
        r = got[k]
        if q <= 0:
            want = ("failed", "Quantity must be positive")
        elif not sku:
            want = ("failed", "SKU required")
        elif key == "old" or key in known and key is not None:
            want = ("repeated", None)
            assert r.order_id == ("order-old" if key == "old" else known[key])
        elif left.get(sku, 0) < q:
            want = ("failed", f"Insufficient inventory for SKU: {sku}")
        else:
            sub, rate = price * q, {"USD": 1.0, "EUR": 1.08}[cur]
            c = next((c for c in coupons if c[0] == code), None)
            usd = sub * rate
            if c and c[4] and sub >= c[3] and (c[1] == "PERCENTAGE" or c[2] < sub):
                usd = usd * (1 - c[2] / 100) if c[1] == "PERCENTAGE" else usd - c[2]
            usd = max(0.0, usd)
            left[sku] -= q
            known[key] = f"order-{k}"
            want = ("confirmed", None)
            assert r.total == pytest.approx(usd / rate, abs=0.011) and r.order_id == f"order-{k}"
        assert (r.status, r.reason) == want, k
    assert any(r.status == "repeated" and r.sku != got[int(r.order_id[6:])].sku for r in got.values() if (r.order_id or "")[6:].isdigit())  # under another SKU
    assert checkout.new_orders(out).count() == checkout.audit_rows(out).count() == sum(r.status == "confirmed" for r in got.values())
    assert all(len(r.errors) == 2 for r in checkout.notifications(out).collect())


def test_carried_state_is_linear_and_right(spark):
    import time

    rows = [("a", k // 3) for k in range(120_000)]
    df = spark.createDataFrame(rows, "ip string, t long")
    began = time.time()
    n = timeseries.rate_limit(df, "ip", "t", 2, 60).filter("allowed").count()
    assert time.time() - began < 30
    held, want = [], 0
    for _, t in rows:
        held = [x for x in held if t - x < 60]
        if len(held) < 2:
            held.append(t)
            want += 1
    assert n == want


def test_calibration_of_the_ensemble(spark):
    x = models.healthy_snapshots(400, seed=5)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{c} double" for c in models.FEATURES))
    import numpy as np

    model = models.default_ensemble()
    bar = models.calibrated_threshold(df, model)
    assert bar == pytest.approx(float(np.percentile(model.score(x)[0], 99)), rel=1e-9)
    assert models.calibrated_threshold(df.limit(0), model) == model.threshold
    bad = spark.createDataFrame([(400 + k, 0.98, 0.45, 0.96, 0.06, 0.92, 0.97) for k in range(5)], df.schema)
    scored = models.ensemble_scores(df.filter("k >= 395").unionByName(bad), model).withColumn("s", F.lit("x"))
    assert timeseries.incident_start(scored, ["s"], "k", "is_anomaly", 2).first().start == 400


def test_refused_requests_do_not_meet_in_one_task(spark):
    rows = spark.range(0, 8000, 1, 8).select(
        F.col("id").alias("request_id"), F.col("id").alias("at"), F.lit(1).alias("customer_id"), F.when(F.col("id") % 2 == 0, " ").otherwise(F.concat(F.lit("s"), (F.col("id") % 97).cast("string"))).alias("sku"),
        F.lit(1).alias("quantity"), F.lit(20.0).alias("unit_price"), F.lit("USD").alias("currency"), F.lit("TEN").alias("coupon_code"), F.lit(None).cast("string").alias("idempotency_key"),
    )
    coupons = spark.createDataFrame([("TEN", "FIXED", 10.0, 0.0, True)], "code string, kind string, value double, minimum double, active boolean")
    stock = spark.createDataFrame([(f"s{k}", 1000) for k in range(97)], "sku string, qty int")
    old = spark.createDataFrame([("o", 1.0, "old")], "order_id string, total double, idempotency_key string")
    for orders in (None, old):
        out = checkout.checkout(rows, coupons, stock, orders)
        assert {(r.status, r.reason): r["count"] for r in out.groupBy("status", "reason").count().collect()} == {("failed", "SKU required"): 4000, ("confirmed", None): 4000}
        blank = out.filter("status = 'failed'").groupBy(F.spark_partition_id()).count()
        assert blank.agg(F.max("count")).first()[0] <= 2500


def test_each_metric_is_searched_once(spark):
    df = spark.createDataFrame([(1, "\U0001f525" * 60 + "\ncpu: 10 → 50 memory: 40 error rate: 3%\nend")], "id int, text string")
    out = metrics.text_snapshots(df, "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(metrics.METRICS["cpu_pct"][0]) <= 2  # in the block, and the number in what was found
    # the line is found behind characters that take two units of UTF-16
    got = {(r.block, r.label): (r.cpu_pct, r.mem_pct, r.error_rate) for r in metrics.text_snapshots(df.selectExpr("id", "concat(text, '\n\n.') AS text"), "text").collect()}
    assert got == {(0, "baseline"): (0.1, 0.4, 0.03), (0, "incident"): (0.5, 0.5, 0.5)}
