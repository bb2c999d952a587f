"""Queries of the window selector, of the benchmark over a corpus of post-mortems, and of lists re-ranked by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark, retrieval, windows
from ..session import shared_path
from ..sources import corpus
from .incident import STOPS, S, Tables, query, r6, seconds

TICKETS = ("checkout is slow this morning", "errors at 2pm for some users", "nothing works after lunch", "no details", "pages AT 11:30 PM and overnight", "")

SIGNALS = f"""i AS (SELECT user_id AS incident_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS rep, CASE user_id % 6 {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(TICKETS))} END AS txt FROM events WHERE user_id % 11 <> 3 OR event_type = 'purchase' GROUP BY user_id),
g AS (SELECT user_id AS incident_id, CASE event_type WHEN 'error' THEN 'vendor' WHEN 'signup' THEN 'deploy' WHEN 'view' THEN 'page' ELSE 'change' END AS kind, {S} AS t, {S} + CAST(floor(value) AS BIGINT) * 60 AS e,
 CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' WHEN value > 20 THEN 'medium' ELSE 'low' END AS severity, value AS magnitude FROM events WHERE event_type IN ('error', 'signup', 'click') OR (event_type = 'view' AND user_id % 5 > 0)),
x AS (SELECT incident_id, rep // 86400 * 86400 AS d, rep, lower(txt) AS txt FROM i),
a AS ({' UNION ALL '.join(f"SELECT incident_id, d + {3600 * a} AS t, d + {3600 * b} AS e FROM x WHERE contains(txt, '{p}')" for p, a, b in windows.ANCHORS)}
 UNION ALL SELECT incident_id, d + c - 1800, d + c + 1800 FROM (SELECT incident_id, d, (CAST(h AS INT) % 12 + CASE WHEN p = 'pm' THEN 12 ELSE 0 END) * 3600 + coalesce(TRY_CAST(m AS INT), 0) * 60 AS c
  FROM (SELECT incident_id, d, regexp_extract(txt, '{windows.CLOCK}', 1) AS h, regexp_extract(txt, '{windows.CLOCK}', 2) AS m, regexp_extract(txt, '{windows.CLOCK}', 3) AS p FROM x WHERE regexp_matches(txt, '{windows.CLOCK}')))),
s AS (SELECT incident_id, kind, t, e, severity, magnitude FROM g UNION ALL SELECT incident_id, 'text', t, e, NULL, NULL FROM a)"""

EVIDENCE = """ev AS (SELECT incident_id, kind, t, CASE WHEN kind = 'text' THEN e ELSE t END AS te,
 CASE kind WHEN 'vendor' THEN CASE upper(severity) WHEN 'CRITICAL' THEN 1.3 WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 END::DOUBLE WHEN 'change' THEN 0.9::DOUBLE * least(abs(magnitude), 20) / 20 + 0.1::DOUBLE WHEN 'text' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS w,
 CASE kind WHEN 'vendor' THEN 60 * least(25, greatest(10, (e - t) / 60.0::DOUBLE / 2)) WHEN 'change' THEN 600 WHEN 'deploy' THEN 120 WHEN 'page' THEN 1200 ELSE 1 END::DOUBLE AS sl,
 CASE kind WHEN 'vendor' THEN 300 WHEN 'change' THEN 600 WHEN 'deploy' THEN 1500 WHEN 'page' THEN 300 ELSE 1 END::DOUBLE AS sr FROM {source})"""


def _slots(source: str, name: str) -> str:
    """CTEs from signals to the scored slots of each incident, under names of their own."""
    return f"""{EVIDENCE.format(source=source).replace('ev AS', f'ev{name} AS', 1)},
n{name} AS (SELECT ev.*, rep, unnest(range(greatest(CAST(ceil((rep - lookback + 900) / 300.0) AS BIGINT), CAST(floor((t - 6 * sl) / 300) AS BIGINT)), least(CAST(floor((rep - 900) / 300.0) AS BIGINT), CAST(ceil((te + 6 * sr) / 300) AS BIGINT)) + 1)) AS slot FROM ev{name} ev JOIN k USING (incident_id)),
z{name} AS (SELECT incident_id, kind, slot, w, exp(-0.5 * pow(CASE WHEN slot * 300 < t THEN (t - slot * 300) / sl WHEN slot * 300 > te THEN (slot * 300 - te) / sr ELSE 0 END, 2)) AS k FROM n{name}),
q{name} AS (SELECT incident_id, slot, round(1 - exp(-sum(w * k)), 6) AS conf, {', '.join(f"count(*) FILTER (kind = '{k}' AND k >= 0.1) AS n_{k}" for k in windows.KINDS)} FROM z{name} GROUP BY incident_id, slot),
c{name} AS (SELECT q.* REPLACE (CASE WHEN pg.incident_id IS NULL THEN least(0.8, conf) ELSE conf END AS conf) FROM q{name} q LEFT JOIN (SELECT DISTINCT incident_id FROM {source} WHERE kind = 'page') pg USING (incident_id)),
w{name}1 AS (SELECT incident_id, arg_max(slot, (conf, -slot)) AS slot FROM c{name} GROUP BY incident_id)"""


RANKED = f"""WITH {SIGNALS}, k AS (SELECT incident_id, rep, 86400 AS lookback FROM i), {_slots('s', '')},
w2 AS (SELECT c.incident_id, arg_max(c.slot, (conf, -c.slot)) AS slot FROM c JOIN w1 USING (incident_id) WHERE abs(c.slot - w1.slot) >= 6 GROUP BY c.incident_id),
w3 AS (SELECT c.incident_id, arg_max(c.slot, (conf, -c.slot)) AS slot FROM c JOIN w1 USING (incident_id) JOIN w2 USING (incident_id) WHERE abs(c.slot - w1.slot) >= 6 AND abs(c.slot - w2.slot) >= 6 GROUP BY c.incident_id),
f AS (SELECT r.rank, c.* FROM (SELECT 1 AS rank, * FROM w1 UNION ALL SELECT 2, * FROM w2 UNION ALL SELECT 3, * FROM w3) r JOIN c USING (incident_id, slot))"""


def tickets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Incidents, one for each user (of some only purchases are known), and signals from the users' events and tickets."""
    kind, u = F.col("event_type"), F.col("user_id")
    ticket = F.get(F.array(*[F.lit(x) for x in TICKETS]), u % 6)
    incidents = t.events.filter((u % 11 != 3) | (kind == "purchase")).groupBy(u.alias("incident_id")).agg(F.max(seconds()).alias("reported_at")).withColumn("lookback", F.lit(86400))
    text_of = incidents.select("incident_id", F.explode(windows.text_ranges(F.get(F.array(*[F.lit(x) for x in TICKETS]), F.col("incident_id") % 6), F.col("reported_at"))).alias("r"))
    named = F.when(kind == "error", "vendor").when(kind == "signup", "deploy").when(kind == "view", "page").otherwise("change")
    v = F.col("value")
    severity = F.when(v > 100, "CRITICAL").when(v > 50, "HIGH").when(v > 20, "medium").otherwise("low")
    events = t.events.filter(kind.isin("error", "signup", "click") | ((kind == "view") & (u % 5 > 0)))
    events = events.select(u.alias("incident_id"), named.alias("kind"), seconds().alias("t"), (seconds() + F.floor(v) * 60).alias("t_end"), severity.alias("severity"), v.alias("magnitude"))
    none = F.lit(None)
    return incidents, events.unionByName(text_of.select("incident_id", F.lit("text").alias("kind"), "r.t", "r.t_end", none.cast("string").alias("severity"), none.cast("double").alias("magnitude")))


@query(RANKED + """ SELECT incident_id, CAST(rank AS BIGINT) AS rank, slot * 300 - 900 AS start, slot * 300 + 900 AS "end", conf AS confidence, n_vendor, n_change, n_deploy, n_page, n_text FROM f""")
def incident_windows(t: Tables) -> DataFrame:
    """The three likeliest half hours of each incident, with the evidence that bears on each."""
    incidents, signals = tickets(t)
    return windows.located(signals, incidents)


@query(RANKED + """, b AS (SELECT incident_id, count(*) AS n_windows, max(conf) AS best FROM f GROUP BY incident_id)
SELECT i.incident_id, coalesce(n_windows, 0) AS n_windows, coalesce(best, 0)::DOUBLE AS confidence, i.incident_id NOT IN (SELECT incident_id FROM s WHERE kind = 'page') AS pages_missing, CASE WHEN n_windows IS NULL THEN 'no_evidence_available' END AS coverage_warning, coalesce(best, 0) < 0.4 AS stop FROM i LEFT JOIN b USING (incident_id)""")
def window_coverage(t: Tables) -> DataFrame:
    """Of each incident whether its windows can be relied on."""
    incidents, signals = tickets(t)
    return windows.coverage(windows.located(signals, incidents), signals, incidents)


#: Users whose documents are broken, by the remainder of user_id.
CUT, NO_TICKET, NO_END, LIST = 13, 17, 19, 23
CASES = f"""ii AS (SELECT user_id AS incident_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS rep, CAST(floor(epoch(min(ts) FILTER (event_type = 'purchase'))) AS BIGINT) AS truth, CAST(floor(epoch(max(ts) FILTER (event_type = 'signup'))) AS BIGINT) AS deploy,
 CAST(floor(epoch(min(ts) FILTER (event_type = 'view'))) AS BIGINT) AS page, CAST(floor(epoch(max(ts) FILTER (event_type = 'error'))) AS BIGINT) AS vendor FROM events GROUP BY user_id),
jj AS (SELECT *, CASE WHEN incident_id % {CUT} = 5 THEN 'invalid JSON' WHEN incident_id % {LIST} = 5 THEN 'missing fields: incident_id, ground_truth, ticket' WHEN incident_id % {NO_TICKET} = 5 THEN 'missing fields: ticket' WHEN incident_id % {NO_END} = 5 OR truth IS NULL THEN 'ground_truth missing start/end' END AS reason FROM ii),
k AS (SELECT incident_id, rep, 172800 AS lookback, truth - 900 AS ts0, truth + 2700 AS te0, deploy, page, vendor FROM jj WHERE reason IS NULL),
s AS (SELECT incident_id, 'deploy' AS kind, deploy AS t, NULL AS e, NULL AS severity, NULL AS magnitude FROM k WHERE deploy IS NOT NULL UNION ALL SELECT incident_id, 'page', page, NULL, NULL, NULL FROM k WHERE page IS NOT NULL
 UNION ALL SELECT incident_id, 'vendor', vendor, vendor + 3600, 'HIGH', NULL FROM k WHERE vendor IS NOT NULL)"""


def write_corpus(t: Tables) -> str:
    """A JSON file for each user in a folder of its own, some of them broken; the folder."""
    s = seconds()
    kind, u = F.col("event_type"), F.col("user_id")
    first = lambda k, pick: pick(F.when(kind == k, s))
    i = t.events.groupBy("user_id").agg(F.max(s).alias("rep"), first("purchase", F.min).alias("truth"), first("signup", F.max).alias("deploy"), first("view", F.min).alias("page"), first("error", F.max).alias("vendor"))
    quoted = lambda c: F.concat(F.lit('"'), corpus.iso(c), F.lit('"'))
    given = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*parts)).otherwise("")
    end = F.when(u % NO_END == 5, "").otherwise(F.concat(F.lit(', "end": '), quoted(F.col("truth") + 2700)))
    truth = F.when(F.col("truth").isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"start": '), quoted(F.col("truth") - 900), end, F.lit("}")))
    ticket = F.when(u % NO_TICKET == 5, "").otherwise(F.concat(F.lit(', "ticket": {"title": "t", "description": null, "reported_at": '), quoted(F.col("rep")), F.lit("}")))
    body = F.concat(
        F.lit('{"incident_id": "'), u.cast("string"), F.lit('",\n "ground_truth": '), truth, ticket, F.lit(', "lookback_hours": 48,\n "deploys": ['), given("deploy", F.lit('{"merged_at": '), quoted(F.col("deploy")), F.lit("}")),
        F.lit('],\n "pages": ['), given("page", F.lit('{"paged_at": '), quoted(F.col("page")), F.lit("}")), F.lit('],\n "vendor_anomalies": ['),
        given("vendor", F.lit('{"severity": "HIGH", "start": '), quoted(F.col("vendor")), F.lit(', "end": '), quoted(F.col("vendor") + 3600), F.lit("}")), F.lit("]}"),
    )
    body = F.when(u % CUT == 5, F.substring(body, 1, 50)).when(u % LIST == 5, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    folder = shared_path(t.spark, "corpus")
    corpus.write_documents(i.select(F.concat(F.lit("INC-"), u.cast("string"), F.lit(".json")).alias("name"), body.alias("body")), folder)
    return folder


@query(f"WITH {CASES} SELECT 'INC-' || incident_id || '.json' AS file, reason, CASE WHEN reason IS NULL THEN CAST(incident_id AS VARCHAR) END AS incident_id, CASE WHEN reason IS NULL THEN strftime(make_timestamp(truth * 1000000 - 900000000), '%Y-%m-%dT%H:%M:%SZ') END AS truth_start FROM jj")
def corpus_load(t: Tables) -> DataFrame:
    """Every document of a folder, and why it is not usable."""
    rows = corpus.load_corpus(t.spark, write_corpus(t))
    good = F.col("reason").isNull()
    return rows.select("file", "reason", F.when(good, F.col("doc.incident_id")).alias("incident_id"), F.when(good, corpus.iso(corpus.seconds_of(F.col("doc.ground_truth.start")))).alias("truth_start"))


@query(f"""WITH {CASES}, {_slots('s', 'a')}, sb AS (SELECT * FROM s WHERE kind <> 'vendor'), {_slots('sb', 'b')},
p AS (SELECT incident_id, unnest([{{'n': 'naive_page', 's': page - 900, 'e': page + 900}}, {{'n': 'naive_deploy', 's': deploy + 600, 'e': deploy + 2400}}, {{'n': 'vendor_only', 's': vendor, 'e': vendor + 3600}}]) AS x FROM k),
y AS (SELECT incident_id, x.n AS strategy, x.s AS s, x.e AS e FROM p UNION ALL SELECT k.incident_id, 'selector', slot * 300 - 900, slot * 300 + 900 FROM k LEFT JOIN wa1 USING (incident_id)
 UNION ALL SELECT k.incident_id, 'selector_no_vendor', slot * 300 - 900, slot * 300 + 900 FROM k LEFT JOIN wb1 USING (incident_id)),
r AS (SELECT strategy, y.s IS NOT NULL AS applicable, (ts0 + te0) / 2.0 BETWEEN y.s AND y.e AS hit, CASE WHEN y.s IS NOT NULL THEN greatest(0, least(y.e, te0) - greatest(y.s, ts0)) / CAST(greatest(y.e, te0) - least(y.s, ts0) AS DOUBLE) END AS iou,
 CAST(abs((y.s + y.e) / 2.0 - (ts0 + te0) / 2.0) / 60.0 AS DOUBLE) AS off FROM y JOIN k USING (incident_id))
SELECT strategy, count(*) AS n, count(*) FILTER (applicable) AS applicable, round(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 6)::DOUBLE AS hit_rate, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg(iou), 6) AS mean_iou, round(quantile_cont(off, 0.5), 6) AS median_offset FROM r GROUP BY strategy""")
def corpus_scoreboard(t: Tables) -> DataFrame:
    """From the documents of a folder to the scores of five strategies."""
    cases = corpus.postmortems(corpus.load_corpus(t.spark, write_corpus(t)))
    board = benchmark.benchmark(cases)
    return board.select("strategy", "n", "applicable", *[r6(F.col(c)).alias(c) for c in ("hit_rate", "median_iou", "mean_iou", "median_offset")])


@query(f"""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS no, count(*) OVER () AS k FROM benchmark),
d AS (SELECT b.item_id, doc_id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(documents.text, ''))), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS ts FROM documents JOIN b ON doc_id % k = no),
q AS (SELECT item_id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS qs FROM b),
st AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS n, greatest(sum(len(ts)) / count(*), 1e-10) AS al FROM d GROUP BY item_id),
p AS (SELECT item_id, doc_id, any_value(l) AS l, term, count(*) AS tf FROM (SELECT item_id, doc_id, CAST(len(ts) AS DOUBLE) AS l, unnest(ts) AS term FROM d) GROUP BY item_id, doc_id, term),
df AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY item_id, term), u AS (SELECT DISTINCT item_id, unnest(qs) AS term FROM q),
s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS score, list(term) AS found FROM p JOIN df USING (item_id, term) JOIN u USING (item_id, term) JOIN st USING (item_id) GROUP BY item_id, doc_id),
a AS (SELECT d.item_id, d.doc_id, coalesce(round(score, 9), 0) AS score, coalesce(found, []) AS found FROM d LEFT JOIN s USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 3)
SELECT item_id, doc_id, rank, round(score, 6)::DOUBLE AS score, array_to_string(list_filter(qs, lambda w: list_contains(found, w)), ' ') AS terms FROM r JOIN q USING (item_id)""")
def bm25_rerank(t: Tables) -> DataFrame:
    """The three best of each benchmark item's own candidates, and the item's words that each of them has, in the item's order."""
    k = t.benchmark.count()
    numbered = t.benchmark.withColumn("_no", F.row_number().over(retrieval.Window.orderBy("item_id")) - 1).select("item_id", "_no")  # a small list of queries
    candidates = t.documents.select("doc_id", "text").join(F.broadcast(numbered) if k <= 10_000 else numbered, F.col("doc_id") % max(1, k) == F.col("_no")).select("item_id", "doc_id", "text")
    out = retrieval.rerank(candidates, t.benchmark.select("item_id", "text"), "doc_id", "item_id", k=3)
    return out.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"), F.array_join("terms", " ").alias("terms"))
