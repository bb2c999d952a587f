"""Queries of stores: checkpoints, checks of records, orders and stock; added to those of `incident`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checked, checkout
from ..sources import checkpoints
from .incident import Tables, learning_records, query


def s(c):
    return c.cast("string")


@query("""SELECT 'INC-' || o_orderkey AS incident_id, 'signals' AS last_completed_phase, CAST(2 AS INT) AS n_outputs, '{"n":' || o_custkey || '}' AS signals FROM orders WHERE o_orderkey % 6 = 0""")
def checkpoint_read(t: Tables) -> DataFrame:
    """Checkpoints by their five rules: a sixth each is right, corrupt, a list, of another version, of another incident and missing."""
    k = F.col("o_orderkey")
    doc = lambda version, name: F.concat(F.lit(f'{{"format_version": {version}, "incident_id": "'), name, F.lit('", "last_completed_phase": "signals", "phase_outputs": {"intake": null, "signals": {"n":'), s(F.col("o_custkey")), F.lit("}}}"))
    name = F.concat(F.lit("INC-"), s(k))
    text = F.when(k % 6 == 0, doc(1, name)).when(k % 6 == 1, F.substring(doc(1, name), 1, 60)).when(k % 6 == 2, F.concat(F.lit("["), doc(1, name), F.lit("]"))).when(k % 6 == 3, doc(999, name)).when(k % 6 == 4, doc(1, F.lit("INC-x")))
    out = checkpoints.accepted(t.orders.select(name.alias("id"), text.alias("text")), "id", "text")
    return out.select("incident_id", "last_completed_phase", F.size("phase_outputs").alias("n_outputs"), F.col("phase_outputs")["signals"].alias("signals"))


PHASE = "['intake', 'signals', 'prior_incident', 'fix_and_test'][o_orderkey % 4 + 1]"


@query(f"""WITH p AS (SELECT 'INC-' || o_custkey AS incident_id, {PHASE} AS phase, o_orderkey AS seq, '{{"o":' || o_orderkey || '}}' AS output, CASE WHEN o_orderkey % 3 = 0 THEN 'stage' || (o_orderkey % 5) END AS st FROM orders),
l AS (SELECT incident_id, phase, max_by(output, seq) AS output FROM p GROUP BY ALL), c AS (SELECT incident_id, string_agg(phase || '=' || output, ';' ORDER BY phase) AS outputs FROM l GROUP BY incident_id)
SELECT incident_id, max_by(phase, seq) AS last_completed_phase, min_by(st, seq) FILTER (st IS NOT NULL) AS rca_stage, any_value(outputs) AS outputs FROM p JOIN c USING (incident_id) GROUP BY incident_id""")
def checkpoint_merge(t: Tables) -> DataFrame:
    """The checkpoint of each customer after all orders as phases."""
    k = F.col("o_orderkey")
    phases = t.orders.select(
        F.concat(F.lit("INC-"), s(F.col("o_custkey"))).alias("incident_id"), F.get(F.array(*[F.lit(p) for p in checked.PHASES]), k % 4).alias("phase"), k.alias("seq"),
        F.concat(F.lit('{"o":'), s(k), F.lit("}")).alias("output"), F.when(k % 3 == 0, F.concat(F.lit("stage"), s(k % 5))).alias("rca_stage"),
    )
    out = checkpoints.merged(None, phases, F.lit("2024-01-01T00:00:00Z"))
    pairs = F.transform(F.array_sort(F.map_entries("phase_outputs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("incident_id", "last_completed_phase", "rca_stage", F.array_join(pairs, ";").alias("outputs"))


@query("""SELECT o_orderkey, CAST((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 7 = 0)::INT AS INT) AS n_errors,
CASE WHEN o_orderkey % 2 = 0 THEN 'fix_kind must be one of code, config, data, infra, no_fix_needed, spec_gap, not magic' WHEN o_orderkey % 3 = 0 THEN 'fix_outcome must be one of partial, rolled_back, unknown, worked, not fine'
WHEN o_orderkey % 5 = 0 THEN 'confidence must be one of high, low, medium, not sure' WHEN o_orderkey % 7 = 0 THEN 'signal_pattern is empty' END AS first_error FROM orders""")
def record_checks(t: Tables) -> DataFrame:
    """What is wrong with learning records before they are stored."""
    k = F.col("o_orderkey")
    errors = checked.record_errors(F.when(k % 2 == 0, "magic").otherwise("code"), F.when(k % 3 == 0, "fine"), F.when(k % 5 == 0, "sure"), F.when(k % 7 == 0, " \n").otherwise("p"))
    return t.orders.select("o_orderkey", F.size(errors).alias("n_errors"), F.get(errors, F.lit(0)).alias("first_error"))


@query("""SELECT event_id, CAST((event_type NOT IN ('error', 'click'))::INT + (event_type = 'purchase')::INT + (event_id % 4 = 0)::INT AS INT) AS n_errors FROM events""")
def event_checks(t: Tables) -> DataFrame:
    """What is wrong with health events before they are appended."""
    kind = F.col("event_type")
    errors = checked.event_errors(F.when(kind == "error", "signals").when(kind == "click", "validator").otherwise("lunch"), F.when(kind == "purchase", "fatal").otherwise("info"), F.when(F.col("event_id") % 4 == 0, "").otherwise("x"))
    return t.events.select("event_id", F.size(errors).alias("n_errors"))


@query("""WITH r AS (SELECT 'inc-' || o_custkey AS incident_id, max(o_orderkey) AS recorded_at, max_by(CASE o_orderstatus WHEN 'F' THEN 'worked' WHEN 'P' THEN 'partial' ELSE 'rolled_back' END, o_orderkey) AS fix_outcome FROM orders GROUP BY o_custkey)
SELECT incident_id, recorded_at, CASE WHEN recorded_at % 2 = 0 THEN 'unknown' ELSE fix_outcome END AS fix_outcome, CASE WHEN recorded_at % 2 = 0 THEN recorded_at + 1 END AS updated_at FROM r""")
def outcome_updates(t: Tables) -> DataFrame:
    """Learning records after the outcome of half of them was set anew."""
    r = learning_records(t).withColumn("updated_at", F.lit(None).cast("long"))
    new = r.filter("recorded_at % 2 = 0").select("incident_id", F.lit("unknown").alias("fix_outcome"), (F.col("recorded_at") + 1).alias("updated_at"))
    return checked.updated_outcomes(r, new, "incident_id").select("incident_id", "recorded_at", "fix_outcome", "updated_at")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"root_failure": {"service": "a"}}' WHEN 1 THEN '{"n":"1","root_failure":"{}"}' WHEN 2 THEN '{}' ELSE '{"root_failure": null}' END AS result, CAST(CASE WHEN event_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS INT) AS n_warnings FROM events""")
def trace_repair(t: Tables) -> DataFrame:
    """Results of a trace, repaired."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"root_failure": {"service": "a"}}').when(k == 1, '{"n": 1, "root_failure": "svc"}').when(k == 2, "[1, 2]").otherwise('{"root_failure": null}')
    result, warnings = checked.repaired_trace(raw)
    return t.events.select("event_id", result.alias("result"), F.size(warnings).alias("n_warnings"))


@query("""SELECT o_orderkey, array_to_string(list_filter(['id', 'title', 'window'], lambda k: NOT list_contains(CASE o_orderkey % 3 WHEN 0 THEN ['id', 'title'] WHEN 1 THEN ['other'] ELSE ['window', 'id', 'title'] END, k)), ',') AS missing FROM orders""")
def config_gaps(t: Tables) -> DataFrame:
    """Keys that a configuration lacks."""
    k = F.col("o_orderkey") % 3
    array = lambda *x: F.array(*[F.lit(v) for v in x])
    present = F.when(k == 0, array("id", "title")).when(k == 1, array("other")).otherwise(array("window", "id", "title"))
    return t.orders.select("o_orderkey", F.array_join(checked.missing_keys(["id", "title", "window"], present), ",").alias("missing"))


def _requests(t: Tables) -> DataFrame:
    """Line items as orders: every 11th without a quantity, every 13th without a SKU; lines of one order and SKU share a key."""
    o = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sku = F.when(o % 13 == 0, " ").otherwise(F.concat(F.lit("SKU-"), s(F.col("l_suppkey"))))
    return t.lineitem.select(
        o.alias("request_id"), F.col("l_orderkey").alias("at"), (F.col("l_partkey") % 50).alias("customer_id"), sku.alias("sku"), F.when(o % 11 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("quantity"),
        F.when(o % 17 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("unit_price"), F.when(o % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        F.when(o % 3 == 0, "TEN").when(o % 3 == 1, "NONE").alias("coupon_code"), F.when(o % 5 == 0, F.concat(s(F.col("l_orderkey")), F.lit("/"), s(F.col("l_suppkey")))).alias("idempotency_key"),
    )


def _checkout(t: Tables) -> DataFrame:
    coupons = t.spark.createDataFrame([("TEN", "FIXED", 10.0, 0.0, True), ("OFF", "PERCENTAGE", 50.0, 0.0, False)], "code string, kind string, value double, minimum double, active boolean")
    stock = t.supplier.select(F.concat(F.lit("SKU-"), s(F.col("s_suppkey"))).alias("sku"), F.lit(2000).alias("qty"))
    return checkout.checkout(_requests(t), coupons, stock)


@query()
def checkout_orders(t: Tables) -> DataFrame:
    """Every line item as an order request, in order, against 2,000 pieces of each SKU."""
    return _checkout(t).select("request_id", "sku", "status", "reason", "order_id", F.round("total", 2).alias("total"))


@query()
def checkout_messages(t: Tables) -> DataFrame:
    """The messages of the confirmed orders, none of which the receiver takes."""
    return checkout.notifications(_checkout(t)).select("order_id", "type", F.size("errors").alias("n_errors"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_partkey % 9 = 0 THEN 'no such id!' ELSE 'SKU-' || (l_suppkey * 2) END AS sku, CASE WHEN l_partkey % 9 = 0 THEN 400 ELSE 200 END AS code,
CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey * 2) THEN 7 ELSE 0 END AS qty FROM lineitem""")
def stock_lookup(t: Tables) -> DataFrame:
    """Stock by id: unknown ids have none, invalid ids are refused."""
    bad = F.col("l_partkey") % 9 == 0
    asked = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.when(bad, "no such id!").otherwise(F.concat(F.lit("SKU-"), s(F.col("l_suppkey") * 2))).alias("sku"))
    stock = t.supplier.select(F.concat(F.lit("SKU-"), s(F.col("s_suppkey"))).alias("sku"), F.lit(7).alias("qty"))
    return checkout.stock_of(asked, stock)


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 10 = 0 THEN 'CANCELLED' WHEN o_orderkey % 10 = 5 THEN 'SHIPPED' ELSE 'CONFIRMED' END AS status FROM orders""")
def order_upserts(t: Tables) -> DataFrame:
    """Orders after some were stored again as cancelled and others had their status set."""
    old = t.orders.select(F.col("o_orderkey").alias("order_id"), F.lit("CONFIRMED").alias("status"))
    new = old.filter("order_id % 10 = 0").withColumn("status", F.lit("CANCELLED"))
    return checkout.with_status(checkout.upserted(old, new, "order_id"), old.filter("order_id % 10 = 5").withColumn("status", F.lit("SHIPPED")))


@query("""SELECT 'ORDER_' || l_linestatus AS event_type, CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS timestamp_utc FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)""")
def order_trail(t: Tables) -> DataFrame:
    """The log of the first order, oldest first."""
    first = t.lineitem.agg(F.min("l_orderkey")).first()[0]
    rows = t.lineitem.select(F.concat(F.lit("ORDER_"), "l_linestatus").alias("event_type"), s(F.col("l_orderkey")).alias("order_id"), F.col("l_linenumber").alias("timestamp_utc"))
    return checkout.audit_trail(rows, str(first))
