"""Queries of the contracts between phases; they are added to those of `incident`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts
from .incident import Tables, query

PHRASES = ("inventory-service", "checkout", "payment gateway", "warehouse stock", "nothing known")
TERMS = [
    ("inventory-service", "inventory-service", 1.0), ("inventory-service", "stock", 0.4), ("inventory-service", "warehouse", 0.4), ("checkout-service", "checkout", 0.6),
    ("payment-service", "payment", 0.6), ("payment-service", "gateway", 0.3), ("notification-service", "gateway", 0.3), ("notification-service", "payment", 0.55),
]


@query(f"""WITH terms(service, term, weight) AS (VALUES {", ".join(f"('{s}', '{w}', CAST({x} AS DOUBLE))" for s, w, x in TERMS)}), e AS (SELECT event_id, [{", ".join(f"'{p}'" for p in PHRASES)}][event_id % 5 + 1] AS phrase FROM events),
m AS (SELECT event_id, service, 1 - product(1 - weight) AS score FROM (SELECT DISTINCT event_id, term FROM (SELECT event_id, unnest(regexp_extract_all(lower('Error in ' || phrase), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS term FROM e)) JOIN terms USING (term) GROUP BY event_id, service),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, service) AS k, lead(score) OVER (PARTITION BY event_id ORDER BY score DESC, service) AS following FROM m)
SELECT e.event_id, r.service, round(r.score, 6) AS score, r.service IS NULL OR coalesce(r.score - r.following < 0.1, false) AS needs_disambiguation FROM e LEFT JOIN r ON r.event_id = e.event_id AND r.k = 1""")
def module_route(t: Tables) -> DataFrame:
    """The service of each ticket, by names and synonyms."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % 5 + 1).cast("int"))
    tickets = t.events.select("event_id", F.concat(F.lit("Error in "), phrase).alias("text"))
    terms = t.spark.createDataFrame(TERMS, "service string, term string, weight double")
    return contracts.routed(tickets, F.broadcast(terms), "event_id", "text").withColumn("score", F.round("score", 6))


@query("""SELECT DISTINCT l_orderkey AS incident, 'svc' || (l_suppkey % 7) || '/main.py' AS file, 'contradiction: svc' || (l_suppkey % 7) || '/main.py lies outside the services with signals' AS warning
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_partkey % 7 = l.l_suppkey % 7)""")
def phase_contradictions(t: Tables) -> DataFrame:
    """Files changed outside the services that gave signals."""
    name = lambda c: F.concat(F.lit("svc"), (F.col(c) % 7).cast("string"))
    incident = F.col("l_orderkey").alias("incident")
    files = t.lineitem.select(incident, F.concat(name("l_suppkey"), F.lit("/main.py")).alias("file"))
    return contracts.contradictions(files, t.lineitem.select(incident, name("l_partkey").alias("service")), "incident")


@query("""SELECT n_nationkey, 0 AS pos, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Hypothesis 1' END AS description, CASE WHEN n_nationkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(n_nationkey AS DOUBLE) / 100 END AS confidence FROM nation
UNION ALL SELECT n_nationkey, 1, 'Hypothesis 2', CAST(0.5 AS DOUBLE) FROM nation""")
def hypothesis_repair(t: Tables) -> DataFrame:
    """Hypotheses with their missing fields filled in."""
    k = F.col("n_nationkey")
    item = lambda d, h, c: F.struct(d.cast("string").alias("description"), h.cast("string").alias("hypothesis"), c.cast("double").alias("confidence"))
    given = F.array(item(F.when(k % 2 == 0, F.col("n_name")), F.when(k % 3 == 0, "h"), F.when(k % 4 != 0, k.cast("double") / 100)), item(F.lit(None), F.lit(None), F.lit(None)))
    return t.nation.select("n_nationkey", F.posexplode(contracts.repaired_hypotheses(given)).alias("pos", "h")).select("n_nationkey", "pos", "h.description", "h.confidence")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'No description' END AS description, 'MEDIUM' AS severity, CASE WHEN n_nationkey % 3 = 0 THEN 'a.py' ELSE 'unknown' END AS service FROM nation""")
def code_repair(t: Tables) -> DataFrame:
    """Code issues with their missing fields filled in."""
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    fields = {"description": none, "message": none, "title": F.when(k % 2 == 0, F.col("n_name")), "severity": none, "service": none, "file": F.when(k % 3 == 0, "a.py")}
    issues = F.array(F.struct(*[v.alias(c) for c, v in fields.items()]))
    return t.nation.select("n_nationkey", F.explode(contracts.repaired_items(issues, contracts.CODE_ITEM)).alias("i")).select("n_nationkey", "i.description", "i.severity", "i.service")


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'invalid' WHEN 3 THEN 'too_large' ELSE 'ok' END AS status, CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"id": ' || event_id || '}' END AS body FROM events""")
def request_bodies(t: Tables) -> DataFrame:
    """Requests, a quarter each empty, right, broken and too large for a cap of 64 bytes."""
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, "").when(e % 4 == 1, F.concat(F.lit('{"id": '), e.cast("string"), F.lit("}"))).when(e % 4 == 2, "{bad").otherwise('{"v": "' + "y" * 100 + '"}')
    status, body = contracts.request_body(raw, 64)
    return t.events.select("event_id", status.alias("status"), body.alias("body"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'EE' WHEN 'click' THEN 'WW' ELSE '  ' END || '  ' || '?' || '  ' || rpad('INC-' || user_id, 15, ' ') || '  ' || rpad('intake', 14, ' ') || '  ' || event_type || '  {}' AS line FROM events""")
def health_lines(t: Tables) -> DataFrame:
    """A line of text for each event."""
    kind = F.col("event_type")
    severity = F.when(kind == "error", "error").when(kind == "click", "warn").otherwise("info")
    none = F.lit(None).cast("string")
    return t.events.select("event_id", contracts.health_line(severity, none, F.concat(F.lit("INC-"), F.col("user_id").cast("string")), F.lit("intake"), kind, none).alias("line"))


@query(r"""SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all('${HOST_' || user_id || '} ${KEY} ${lower} ${KEY}', '\$\{([A-Z0-9_]+)\}', 1))), ',') AS names FROM events""")
def env_references(t: Tables) -> DataFrame:
    """Names of the variables that a text refers to."""
    text = F.concat(F.lit("${HOST_"), F.col("user_id").cast("string"), F.lit("} ${KEY} ${lower} ${KEY}"))
    return t.events.select("event_id", F.array_join(contracts.env_references(text), ",").alias("names"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 20")
def notification_page(t: Tables) -> DataFrame:
    """A page of the newest rows; the limit given is no number."""
    return contracts.page(t.events.select("event_id", "event_type"), [F.desc("event_id")], "many", 20)
