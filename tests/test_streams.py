"""Streams in several steps against plain Python: restarts, forgotten keys, bounded buffers, batches that come twice."""

import pytest
from pyspark.sql import functions as F

from faultline.plans import streams
from faultline.session import shared_path
from faultline.sources import checkpoints
from faultline.streaming import processors, stateful


def run(spark, rows, schema, order, build, steps=3):
    """Rows that a stream appends, and its checkpoint."""
    out = shared_path(spark, "out")
    at = streams.replayed(spark.createDataFrame(rows, schema), order, lambda x, c: streams.to_files(build(x), c, out), steps)
    return [tuple(r) for r in spark.read.parquet(out).collect()], at


def test_streaks_go_on_after_a_restart(spark):
    flags = [True, True, None, True, True, True, True, False, True]
    rows = [("a", k, f) for k, f in enumerate(flags)] + [("b", k, True) for k in range(4)] + [(None, 5, True)]
    got, _ = run(spark, rows, "k string, o long, f boolean", "o", lambda x: processors.anomaly_streaks(x, "k", "o", "f"))
    a = sorted(r[1:] for r in got if r[0] == "a")
    assert [r[1] for r in a] == [1, 2, 0, 1, 2, 3, 4, 0, 1]
    assert [r[2] for r in a] == [0, 0, None, 3, 3, 3, 3, None, 8] and [r[0] for r in a if r[3]] == [5]
    assert sorted(r[1:4] for r in got if r[0] == "b") == [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0)]
    assert [r[1:] for r in got if r[0] is None] == [(5, 1, 5, False)]


def test_streaks_of_many_keys_take_few_calls(spark):
    """Keys share calls and state: 3,000 keys in three batches, against plain Python, with state for those in a streak only."""
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(3000) + 2**60, o, rng.random() < 0.6) for o in range(12_000)]
    got, at = run(spark, rows, "k long, o long, f boolean", "o", lambda x: processors.anomaly_streaks(x, "k", "o", "f"))
    state, want = {}, []
    for k, o, flag in rows:
        n, first = state.get(k, (0, None))
        state[k] = (n + 1, first if n else o) if flag else (0, None)
        want.append((k, o, *state[k], state[k][0] == 3))
    assert sorted(got, key=lambda r: r[1]) == want
    held = spark.read.format("statestore").option("stateVarName", "streaks").load(at)
    assert {(r.list_element.key, r.list_element.n, r.list_element.first) for r in held.collect()} == {(k, *v) for k, v in state.items() if v[0]}
    assert held.select("key").distinct().count() <= 1025


def test_limiter_forgets_idle_keys(spark):
    rows = [("a", 1000 + t) for t in (0, 10, 20, 59, 60, 61, 200)] + [("idle", 1005)]
    build = lambda x: processors.limited(x.withColumn("ts", F.timestamp_seconds("t")), "k", "ts", 2, 60)
    got, at = run(spark, rows, "k string, t long", "t", build, 2)
    assert sorted((r[1] - 1000, r[2]) for r in got if r[0] == "a") == [(0, True), (10, True), (20, False), (59, False), (60, True), (61, False), (200, True)]
    assert [r.key for r in processors.held_keys(spark, at).collect()] == ["a"]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_buffers_hold_the_newest(spark, most):
    rows = [("a" if k % 3 else "b", k, f"i{k}") for k in range(60)]
    got, at = run(spark, rows, "k string, o long, item string", "o", lambda x: processors.buffered(x, "k", "o", "item", most))
    held = sorted(tuple(r) for r in processors.buffer_of(spark, at).collect())
    assert held == sorted(x for key in "ab" for x in [r for r in rows if r[0] == key][-most:])
    assert sum(r[1] for r in got) == 60 and max(r[2] for r in got) == min(most, 40)


PHASES = "incident_id string, phase string, output string, rca_stage string, seq long, at string"


def documents(spark, folder):
    return sorted((r.incident_id, r.last_completed_phase, r.rca_stage, r.started_at, r.updated_at, sorted(r.phase_outputs.items())) for r in checkpoints.read_checkpoints(spark, folder).collect())


def test_a_batch_of_phases_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    first = [("I1", "intake", '{"a":1}', None, 1, "t1"), ("I2", "intake", '{"b":2}', "s0", 2, "t2"), ("I1", "signals", "3", "s1", 3, "t3")]
    second = [("I1", "signals", "4", "s2", 4, "t4"), ("I3", "fix_and_test", "null", None, 5, "t5")]
    frames = [spark.createDataFrame(x, PHASES) for x in (first, second)]
    once, again, cut = (str(tmp_path / x) for x in ("once", "again", "cut"))
    for folder in (once, again):
        sink = checkpoints.phase_sink(folder)
        for k in (0, 1) if folder == once else (0, 0, 1, 1, 0):
            sink(frames[k], k)
    want = documents(spark, once)
    assert [d[:5] for d in want] == [("I1", "signals", "s1", "t3", "t5"), ("I2", "intake", "s0", "t3", "t3"), ("I3", "fix_and_test", None, "t5", "t5")]
    assert dict(want[0][5]) == {"intake": '{"a":1}', "signals": "4"} and documents(spark, again) == want
    # cut off between the documents: one has been written, the mark has not
    sink = checkpoints.phase_sink(cut)
    sink(frames[0], 0)
    whole = checkpoints.merged(checkpoints.read_some(frames[1].select("incident_id").distinct(), cut), frames[1].drop("at"), F.lit("t5"))
    checkpoints.write_checkpoints(whole.filter("incident_id = 'I1'"), cut)
    sink(frames[1], 1)
    assert documents(spark, cut) == want
    assert sorted(map(tuple, checkpoints.next_phase(checkpoints.read_checkpoints(spark, cut)).collect())) == [("I1", "prior_incident"), ("I2", "signals"), ("I3", "intake")]


def test_documents_in_a_table_are_those_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checkpoints, "WHOLE_EVERY", 3)
    frames = [spark.createDataFrame([(f"I{(3 * k + j) % 7}", checkpoints.PHASES[(k + j) % 4], f'{{"n":{k}}}', f"s{k}" if j else None, 2 * k + j, f"t{k}") for j in range(2)], PHASES) for k in range(8)]
    frames.insert(4, spark.createDataFrame([], PHASES))
    files, table = str(tmp_path / "files"), str(tmp_path / "table")
    first, second = checkpoints.phase_sink(files), checkpoints.table_sink(table)
    for k, frame in enumerate(frames):
        first(frame, k)
        if k == 5:  # cut off: a table without its mark
            frames[0].write.parquet(f"{table}/batch-5")
        second(frame, k)
        second(frame, k)
    key = lambda r: (r.incident_id, r.last_completed_phase, r.rca_stage, r.started_at, r.updated_at, sorted(r.phase_outputs.items()))
    assert sorted(map(key, checkpoints.read_document_table(spark, table).collect())) == documents(spark, files)
    kinds = checkpoints._marks(table)
    assert kinds[4] == "none" and [kinds[k] for k in (0, 1, 2, 3)] == ["part", "part", "part", "whole"] and list(kinds.values()).count("whole") == 2
    bad = spark.createDataFrame([("I1", "intake", "{", None, 99, "t")], PHASES)
    with pytest.raises(Exception, match="no JSON"):
        second(bad, 9)
    assert 9 not in checkpoints._marks(table)


def test_documents_of_many_incidents_take_few_files(spark, tmp_path):
    import os

    batch = spark.range(0, 5000, 1, 4).select(F.concat(F.lit("I"), F.col("id").cast("string")).alias("incident_id"), F.lit("intake").alias("phase"), F.lit("1").alias("output"), F.lit(None).cast("string").alias("rca_stage"), F.col("id").alias("seq"), F.lit("t").alias("at"))
    checkpoints.table_sink(str(tmp_path))(batch, 0)
    assert checkpoints.read_document_table(spark, str(tmp_path)).count() == 5000
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) < 50


def test_stock_rate_and_windows_as_streams(spark):
    moves = [("s", k, kind, q) for k, (kind, q) in enumerate([("release", 5), ("reserve", 3), ("reserve", 3), ("release", 1), ("reserve", 3)])]
    got, _ = run(spark, moves, "sku string, o long, kind string, quantity long", "o", lambda x: stateful.stock_stream(x, "sku"))
    assert sorted(got) == [("s", 0, True, 5), ("s", 1, True, 2), ("s", 2, False, 2), ("s", 3, True, 3), ("s", 4, True, 0)]
    got, _ = run(spark, [("a", t) for t in (0, 1, 2, 60, 61)], "k string, t long", "t", lambda x: stateful.rate_limit_stream(x, "k", 2, 60))
    assert sorted(got) == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 60, True), ("a", 61, True)]
    events = [("a", t, 1.0) for t in (60, 100, 1700, 1900, 9000)]
    timed = lambda x: x.withColumn("ts", F.timestamp_seconds("t"))
    got, _ = run(spark, events, "k string, t long, value double", "t", lambda x: stateful.tumbling(timed(x), ["k"], late="10 minutes"), 2)
    assert sorted(r[3] for r in got) == [1, 3]  # the last window is still open
    got, _ = run(spark, [("r1", 1), ("r1", 10), ("r2", 5), ("r1", 50)], "k string, t long", "t", lambda x: stateful.once(timed(x), "k"), 2)
    assert sorted(r[0] for r in got) == ["r1", "r2"]
