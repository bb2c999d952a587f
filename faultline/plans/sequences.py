"""Queries of sequence models, searches by several texts and edges of code issues; added to those of `incident`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import graph, models, retrieval, sequences
from .incident import Tables, query, r6, snapshots

DAYS = 10
#: Rounds to whole numbers with no tie at short decimal fractions, where the last bit of a sum would decide.
NEAREST = 0.4871936


#: Shares of events are multiples of simple fractions and would often meet a threshold exactly, where the last bit of a sum
#: decides; scaled by these they do not.
SCALES = {"cpu_pct": 0.97, "error_rate": 0.97, "latency_p99": 0.9976, "throughput": 0.9091}


def stretches(t: Tables) -> DataFrame:
    """Scaled snapshots of users by day, with the number of the ten-day stretch."""
    scaled = {f: F.col(f) * x for f, x in SCALES.items()}
    return snapshots(t).withColumns({"stretch": F.floor(F.col("day") / DAYS), **scaled})


@query()
def sequence_score(t: Tables) -> DataFrame:
    """Each user's ten-day stretches, scored by the recurrent autoencoder."""
    out = sequences.sequence_scores(stretches(t), ["user_id", "stretch"], "day")
    return out.select("user_id", "stretch", "n", r6(F.col("error")).alias("error"), "is_anomaly", "severity", F.array_join(F.col("far_steps").cast("array<string>"), ",").alias("far_steps"), "trend")


SHARE = "count(*) FILTER (event_type = '{}') / CAST(count(*) AS DOUBLE)"
SNAPSHOTS = f"""p AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, {SHARE.format('click')} AS cpu_pct, {SHARE.format('error')} AS error_rate, least(1.0, max(value) / 300) AS latency_p99,
 least(1.0, count(*) / 10.0::DOUBLE) AS throughput, {SHARE.format('view')} AS mem_pct, least(1.0, avg(value) / 100) AS db_query_ms FROM events GROUP BY ALL)"""
_STEP = ", ".join(f"abs({f} - lag({f}) OVER w) AS d_{f}" for f in ("cpu_pct", "error_rate", "latency_p99"))
_SLOPES = ", ".join(f"CASE WHEN count(*) > 1 THEN regr_slope({f}, i) ELSE 0 END AS {f}_slope" for f in models.FEATURES)


@query(f"""WITH {SNAPSHOTS}, n AS (SELECT * REPLACE ({", ".join(f"{f} * {x}::DOUBLE AS {f}" for f, x in SCALES.items())}), CAST(floor(day / {DAYS}.0) AS BIGINT) AS stretch FROM p), s AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS i, {_STEP} FROM n WINDOW w AS (PARTITION BY user_id, stretch ORDER BY day)),
g AS (SELECT user_id, stretch, count(*) AS n, {_SLOPES}, greatest(stddev_pop(d_cpu_pct), stddev_pop(d_error_rate), stddev_pop(d_latency_p99)) AS sd FROM s GROUP BY ALL),
l AS (SELECT *, n >= 3 AND latency_p99_slope > 0.02 AND throughput_slope < -0.02 AS ramp, n >= 3 AND coalesce(sd > 0.15, false) AS swings FROM g)
SELECT user_id, stretch, n, ramp, CASE WHEN ramp THEN 'degrading' WHEN swings THEN 'oscillating' ELSE 'stable' END AS trend, {", ".join(f"CAST(floor({f}_slope * 10000 + {NEAREST}) AS BIGINT) AS {f}_slope" for f in models.FEATURES)} FROM l""")
def sequence_trends(t: Tables) -> DataFrame:
    """Trend of the same stretches, and slopes in ten-thousandths."""
    out = sequences.sequence_scores(stretches(t), ["user_id", "stretch"], "day")
    return out.select("user_id", "stretch", "n", "ramp", "trend", *[F.floor(F.col(f"{f}_slope") * 10000 + NEAREST).alias(f"{f}_slope") for f in models.FEATURES])


@query(f"WITH {SNAPSHOTS} SELECT user_id, day, round(cpu_pct, 6) AS cpu_pct, round(error_rate, 6) AS error_rate, CAST(CASE WHEN day % 2 = 0 THEN round(latency_p99, 6) ELSE 0 END AS DOUBLE) AS latency_p99, CAST(0 AS DOUBLE) AS throughput, round(mem_pct, 6) AS mem_pct, round(db_query_ms, 6) AS db_query_ms FROM p")
def sparse_snapshots(t: Tables) -> DataFrame:
    """Snapshots without throughput and with latency on every other day, filled up."""
    sparse = snapshots(t).withColumn("latency_p99", F.expr("case when day % 2 = 0 then latency_p99 end")).drop("throughput")
    return metrics.filled(sparse, list(models.FEATURES)).select("user_id", "day", *models.FEATURES).withColumns({f: r6(F.col(f)) for f in models.FEATURES})


def _multi_sql() -> str:
    from .incident import SQL

    head = SQL["tfidf_search"].rsplit("SELECT item_id, doc_id, round(s, 3)", 1)[0].rstrip()
    return f"""{head}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS k2 FROM c WHERE s >= 0.05),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, item_id) AS k1 FROM r WHERE k2 <= 10)
SELECT doc_id, item_id, round(s, 3) AS score FROM b WHERE k1 = 1 ORDER BY round(s, 9) DESC, doc_id LIMIT 5"""


@query(_multi_sql())
def tfidf_multi(t: Tables) -> DataFrame:
    """The five documents nearest to any benchmark item."""
    found = retrieval.tfidf_cosine(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"), "doc_id", "item_id")
    return retrieval.best_of_searches(found, "doc_id", "item_id", "cosine").select("doc_id", "item_id", F.round("cosine", 3).alias("score"))


@query("""SELECT 's' || (l_suppkey % 40) AS src, 's' || (l_partkey % 40) AS dst, sum(CASE WHEN l_returnflag = 'R' THEN 2.0::DOUBLE ELSE 1.0 END) AS weight, 'rpc' AS call_type FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY ALL""")
def issue_edges(t: Tables) -> DataFrame:
    """Calls named by code issues; a fifth of the issues name no called service."""
    name = lambda c: F.concat(F.lit("s"), (F.col(c) % 40).cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "TypeError").when(F.col("l_returnflag") == "A", "style")
    issues = t.lineitem.select(name("l_suppkey").alias("service"), F.when(F.col("l_partkey") % 5 > 0, name("l_partkey")).otherwise("").alias("called"), kind.alias("kind"))
    return graph.issue_edges(issues, "service", "called", "kind")
