"""Table functions in SQL give what the column functions give."""

import random

from pyspark.sql import functions as F

from faultline.functions import metrics, tables
from faultline.operators import traces

BITS = ["cpu: 90%", "CPU usage = 12 % → 95%", "error rate: 0.4", "error_rate: 3% -> 7%", "error rate: 2", "latency p99: 120 ms", "p99=9999ms", "rps: 5", "memory: 40", "db time: 9 ms", "noise", "", "\n", "\n\n", " ", "\t", "12 → 13"]
LINES = ["Span 1 | web | GET(/x) | 30 ms | OK", "└─ Span 2 | db | q | 5ms | ERROR → HTTP 502 bad", "  └─ span 3 | db | q | 7 ms | timeout → stored 3 but expected 4", "    └─ Span 4 | c d | op (a, b) | 1 ms | ok", "noise", "", "Span x"]


def test_apm_texts(spark):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choice(BITS) + rng.choice(["\n", " ", "\n\n"]) for _ in range(rng.randint(0, 9)))) for k in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    tables.register(spark)
    got = spark.sql("SELECT t.id, s.* FROM {df} t, LATERAL parse_apm_text(t.text) s", df=df).collect()
    want = metrics.text_snapshots(df, "text").collect()
    assert len(got) > 40 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_traces(spark):
    rng = random.Random(3)
    rows = [(k, n, rng.choice(LINES)) for k in range(60) for n in range(rng.randint(1, 12))]
    lines = spark.createDataFrame(rows, "trace int, no int, line string")
    columns = ["trace", "span_id", "parent_id", "service", "operation", "duration_ms", "status", "detail", "http_status"]
    want = traces.parsed_traces(lines, "trace", "no", "line").select(columns).collect()
    tables.register(spark)
    text = lines.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    got = spark.sql("SELECT t.trace, s.* FROM {text} t, LATERAL parse_trace(t.text) s", text=text).select(columns).collect()
    assert len(got) > 100 and sorted(map(str, got)) == sorted(map(str, want))
    assert spark.sql("SELECT * FROM parse_trace(NULL)").collect() == []
