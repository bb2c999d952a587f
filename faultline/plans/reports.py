"""Queries of whole reports: traces by name, the matrix of a service graph, texts of incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from .incident import EDGES, SPANS, Tables, nation_edges, query, r6, span_rows

DETAIL = "CASE service WHEN 'svc-error' THEN 'HTTP 500 ' || span_id WHEN 'svc-view' THEN CASE WHEN span_id % 3 = 0 THEN 'stored 3 but expected 4' ELSE 'stored 3' END END"


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT *, 'op' || span_id % 4 AS operation, {DETAIL} AS detail, nullif((k + 1) // 2 - 1, -1) AS pk FROM x),
p AS (SELECT c.*, u.span_id AS parent_id FROM n c LEFT JOIN n u ON u.trace_id = c.trace_id AND c.k > 0 AND u.k = (c.k - 1) // 2),
w AS (SELECT trace_id, span_id, duration_ms AS total, lpad(CAST(span_id AS VARCHAR), 12, '0') AS pre, [service || '/' || operation || ' (' || duration_ms || 'ms)'] AS path FROM p WHERE parent_id IS NULL UNION ALL
 SELECT p.trace_id, p.span_id, w.total + p.duration_ms, w.pre || lpad(CAST(p.span_id AS VARCHAR), 12, '0'), list_append(w.path, p.service || '/' || p.operation || ' (' || p.duration_ms || 'ms)') FROM w JOIN p ON p.trace_id = w.trace_id AND p.parent_id = w.span_id),
leaf AS (SELECT w.* FROM w WHERE span_id NOT IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL)), best AS (SELECT trace_id, max(total) AS ms FROM leaf GROUP BY trace_id),
cp AS (SELECT l.trace_id, min_by(array_to_string(l.path, ' > '), l.pre) AS critical_path FROM leaf l JOIN best b ON b.trace_id = l.trace_id AND b.ms = l.total GROUP BY l.trace_id),
rf AS (SELECT w.trace_id, min_by(w.span_id, w.pre) AS root_id FROM w JOIN p USING (trace_id, span_id) WHERE p.status = 'error' AND w.span_id NOT IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL AND status = 'error') GROUP BY w.trace_id),
bk AS (SELECT trace_id, parent_id, min(span_id) AS kid FROM p WHERE status = 'error' GROUP BY ALL),
ch AS (SELECT w.trace_id, min_by(w.span_id, w.pre) AS span_id, 1 AS step FROM w JOIN p USING (trace_id, span_id) WHERE p.status = 'error' GROUP BY w.trace_id UNION ALL SELECT ch.trace_id, bk.kid, ch.step + 1 FROM ch JOIN bk ON bk.trace_id = ch.trace_id AND bk.parent_id = ch.span_id),
fp AS (SELECT ch.trace_id, string_agg(step || ':' || service || ':' || CASE WHEN ch.span_id = root_id THEN 'root' ELSE 'cascaded' END || ':' || operation || ' → ' || coalesce(detail, status), '; ' ORDER BY step) AS failures FROM ch JOIN p ON p.trace_id = ch.trace_id AND p.span_id = ch.span_id JOIN rf ON rf.trace_id = ch.trace_id GROUP BY ch.trace_id),
s AS (SELECT trace_id, count(*) AS n_spans, string_agg(operation || ':' || detail, '; ' ORDER BY span_id) FILTER (status = 'ok' AND contains(detail, 'expected')) AS silent FROM p GROUP BY trace_id),
sv AS (SELECT trace_id, string_agg(service, ',' ORDER BY first) AS services FROM (SELECT trace_id, service, min(span_id) AS first FROM p GROUP BY ALL) GROUP BY trace_id)
SELECT s.trace_id, CAST(n_spans AS INT) AS n_spans, services, critical_path, coalesce(failures, '') AS failures, coalesce(silent, '') AS silent, r.operation || ':' || r.detail AS to_fix FROM s JOIN sv USING (trace_id) JOIN cp USING (trace_id) LEFT JOIN fp USING (trace_id) LEFT JOIN rf USING (trace_id) LEFT JOIN p r ON r.trace_id = s.trace_id AND r.span_id = rf.root_id""")
def trace_reports(t: Tables) -> DataFrame:
    """The whole report of each trace, its lists in one line each."""
    i, service = F.col("span_id"), F.col("service")
    detail = F.when(service == "svc-error", F.concat(F.lit("HTTP 500 "), i.cast("string"))).when(service == "svc-view", F.when(i % 3 == 0, "stored 3 but expected 4").otherwise("stored 3"))
    spans = span_rows(t).withColumns({"operation": F.concat(F.lit("op"), (i % 4).cast("string")), "detail": detail, "http_status": F.when(service == "svc-error", 500)})
    line = lambda c, f, sep="; ": F.array_join(F.transform(c, f), sep)
    return graph.trace_reports(spans, "trace_id").select(
        "trace_id", "n_spans", F.array_join("services", ",").alias("services"), F.array_join("critical_path", " > ").alias("critical_path"),
        line("failure_propagation", lambda x: F.concat_ws(":", x["step"].cast("string"), x["service"], x["type"], x["description"])).alias("failures"),
        line("silent_corruptions", lambda x: F.concat_ws(":", x["operation"], x["description"])).alias("silent"), F.concat_ws(":", F.get("fix_targets.operation", F.lit(0)), F.get("fix_targets.what_to_fix", F.lit(0))).alias("to_fix"),
    ).withColumn("to_fix", F.nullif("to_fix", F.lit("")))


@query(f"WITH {EDGES}, n AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS no FROM (SELECT src AS s FROM e UNION SELECT dst FROM e)) SELECT b.no AS i, a.no AS j, dst AS \"to\", src AS \"from\", round(weight / sum(weight) OVER (PARTITION BY src), 6) AS share FROM e JOIN n a ON a.s = src JOIN n b ON b.s = dst")
def graph_matrix(t: Tables) -> DataFrame:
    """The matrix of the service graph, by numbered services."""
    out = graph.adjacency(nation_edges(t))
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "to", "from", r6(F.col("share")).alias("share"))


@query("""SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || ' ' || p_brand END, ''), CASE WHEN p_partkey % 4 > 0 THEN p_brand END, nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, ''), 'svc' || p_size % 3 || ' svc' || p_size % 7) AS text FROM part""")
def incident_texts(t: Tables) -> DataFrame:
    """Texts of incidents from parts that may be missing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    of = lambda m: F.concat(F.lit("svc"), (size % m).cast("string"))
    symptoms = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    made = text.incident_text(F.col("p_name"), symptoms, F.when(k % 4 > 0, F.col("p_brand")), F.when(k % 5 == 0, "").otherwise(F.col("p_type")), F.array(of(3), of(7)))
    return t.part.select("p_partkey", made.alias("text"))
