"""Orders: guards, repeated requests, stock, coupons, prices, payment, and the tables that a confirmed order leaves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up
from ..session import kept
from . import records

REASONS = ("Quantity must be positive", "SKU required", "Insufficient inventory for SKU: ", "Payment failed: ")

#: Most coupons that are broadcast to the requests.
MOST_COUPONS = 100_000


def charge(amount: Column) -> Column:
    """Whether a payment goes through: all but negative amounts."""
    return amount >= 0


def priced(requests: DataFrame, coupons: DataFrame) -> DataFrame:
    """Adds subtotal, discounted (a valid coupon was given) and total in the request's currency; an unknown or invalid
    coupon gives no discount."""
    c = coupons.select(F.col("code").alias("_code"), "kind", "value", "minimum", "active")
    if c.limit(MOST_COUPONS + 1).count() <= MOST_COUPONS:
        c = F.broadcast(c)  # few codes stand on many requests, so a shuffle by code would have as few tasks
    joined = requests.join(c, F.nullif(F.trim("coupon_code"), F.lit("")) == F.col("_code"), "left").withColumn("subtotal", F.col("unit_price") * F.col("quantity"))
    valid = F.col("_code").isNotNull() & records.coupon_valid(F.col("active"), F.col("kind"), F.col("value"), F.col("minimum"), F.col("subtotal"))
    usd = records.to_usd(F.col("subtotal"), F.col("currency"))
    total = records.order_total(usd, F.when(valid, F.col("kind")).otherwise("NONE"), F.coalesce("value", F.lit(0.0)))
    rate = records.to_usd(F.lit(1.0), F.col("currency"))
    return joined.withColumns({"discounted": valid, "total": half_up(total / rate)}).drop("_code", "kind", "value", "minimum", "active")


def linked_skus(requests: DataFrame) -> DataFrame:
    """sku, group: of the SKUs that requests with one key name, the least that is linked through any number of keys.  SKUs
    whose keys are their own are not among them."""
    shared = requests.filter("idempotency_key is not null").select("idempotency_key", "sku").distinct()
    many = shared.groupBy("idempotency_key").agg(F.count("*").alias("n")).filter("n > 1").select("idempotency_key")
    shared = kept(shared.join(many, "idempotency_key", "left_semi"))
    label = shared.select("sku", F.col("sku").alias("group")).distinct()
    while True:
        least = shared.join(label, "sku").groupBy("idempotency_key").agg(F.min("group").alias("_g"))
        new = kept(shared.join(least, "idempotency_key").groupBy("sku").agg(F.min("_g").alias("group")))
        settled = new.join(label.withColumnRenamed("group", "_old"), "sku").filter(F.col("group") != F.col("_old")).isEmpty()
        label = new
        if settled:
            return label


def checkout(requests: DataFrame, coupons: DataFrame, stock: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Of each request (request_id, at, customer_id, sku, quantity, unit_price, currency, coupon_code, idempotency_key):
    status (confirmed, repeated, failed), reason, order_id and total.

    Requests of a SKU are taken in order of `at` and request_id.  One whose key an order has already, stored or confirmed
    before, is repeated and gets that order; a reservation needs enough stock; a payment that fails gives the stock back.
    The state of a SKU is its stock and the keys that it confirmed; SKUs that share a key are worked off together.
    Requests that a guard refuses and those of stored orders neither read nor change that state: they are settled where
    they are, so a SKU that many of them name (a blank one) takes no task of its own.
    """
    rows = priced(requests, coupons)
    if orders is not None:
        old = orders.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min(F.struct("order_id", F.col("total").cast("double").alias("total"))).alias("_old"))
        # requests without a key find nothing and are spread
        spread = F.when(F.col("idempotency_key").isNull(), 1 + F.pmod(F.hash("request_id"), F.lit(10_000))).otherwise(0)
        rows = rows.withColumn("_spread", spread).join(old.withColumn("_spread", F.lit(0)), ["idempotency_key", "_spread"], "left").drop("_spread")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("struct<order_id:string,total:double>"))
    guard = F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), REASONS[0]).when(F.coalesce(F.trim("sku"), F.lit("")) == "", REASONS[1])
    keep = ["request_id", "at", "customer_id", "sku", "quantity", "currency", "idempotency_key"]
    rows = rows.select(*keep, guard.alias("_guard"), "_old", F.col("total").alias("_price"), charge(F.col("total")).alias("_paid"))
    refused = F.col("_guard").isNotNull()
    settled = rows.filter(refused | F.col("_old").isNotNull()).select(
        *keep, F.when(refused, "failed").otherwise("repeated").alias("status"), F.col("_guard").alias("reason"),
        F.when(~refused, F.col("_old.order_id")).alias("order_id"), F.when(~refused, F.col("_old.total")).alias("total"),
    )
    rows = rows.filter(~refused & F.col("_old").isNull()).drop("_guard", "_old")
    links = linked_skus(rows).withColumnRenamed("group", "_group")
    rows = rows.join(stock.select("sku", F.coalesce("qty", F.lit(0)).cast("long").alias("_stock")), "sku", "left").join(links, "sku", "left")
    rows = rows.select(F.coalesce("_group", "sku").alias("_group"), *keep, F.coalesce("_stock", F.lit(0).cast("long")).alias("_stock"), "_price", "_paid")
    kinds = dict(rows.dtypes)
    asked = ["_group", "request_id", "sku", "quantity", "idempotency_key", "_stock", "_price", "_paid"]

    def run(batches):
        now, started, left, known = None, False, {}, {}
        for batch in batches:
            out = []
            for group, request, sku, quantity, key, opening, price, paid in zip(*[batch.column(c).to_pylist() for c in asked], strict=True):
                if not started or group != now:
                    now, started, left, known = group, True, {}, {}
                have = left.setdefault(sku, opening)
                if key is not None and key in known:
                    out.append(("repeated", None, *known[key]))
                elif have < quantity:
                    out.append(("failed", REASONS[2] + sku, None, None))
                elif not paid:
                    out.append(("failed", REASONS[3] + "negative amount", None, None))
                else:
                    left[sku] = have - quantity
                    order = f"order-{request}"
                    if key is not None:
                        known[key] = (order, price)
                    out.append(("confirmed", None, order, price))
            status, reason, order, total = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(status, pa.string()), pa.array(reason, pa.string()), pa.array(order, pa.string()), pa.array(total, pa.float64())], [*keep, "status", "reason", "order_id", "total"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", status string, reason string, order_id string, total double"
    taken = rows.repartition(F.col("_group")).sortWithinPartitions("_group", "at", "request_id").mapInArrow(run, schema)
    return taken.unionByName(settled)


def new_orders(results: DataFrame) -> DataFrame:
    """Rows of the order table for the confirmed requests."""
    return results.filter("status = 'confirmed'").select("order_id", "customer_id", "sku", "quantity", "total", "currency", F.lit("CONFIRMED").alias("status"), F.col("at").alias("created_at"), "idempotency_key")


def audit_rows(results: DataFrame) -> DataFrame:
    """What is logged of confirmed orders."""
    detail = F.concat(F.lit("total="), F.col("total").cast("string"), F.lit(" currency="), F.col("currency"))
    return results.filter("status = 'confirmed'").select(F.lit("ORDER_CONFIRMED").alias("event_type"), "order_id", "customer_id", detail.alias("detail"), F.col("at").alias("timestamp_utc"))


def notifications(results: DataFrame) -> DataFrame:
    """The messages that are sent for confirmed orders, and why the receiver refuses them: it knows no such type, and the
    customer's id stands for an address."""
    kind, email = F.lit("ORDER_CONFIRMED"), F.col("customer_id").cast("string")
    text = F.concat(F.lit("Your order has been confirmed. Total: "), F.col("total").cast("string"), F.lit(" "), F.col("currency"))
    return results.filter("status = 'confirmed'").select("order_id", email.alias("email"), kind.alias("type"), text.alias("message"), records.notification_errors(F.col("order_id"), email, text, kind).alias("errors"))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with these rows in place of those of the same key, each key once."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]))


def with_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders with the statuses of `changes` (order_id, status); orders without one stay."""
    new = changes.select("order_id", F.col("status").alias("_s"))
    return orders.join(new, "order_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*orders.columns)


def audit_trail(audit: DataFrame, order_id: str) -> DataFrame:
    """One order's log, oldest first."""
    return audit.filter(F.col("order_id") == order_id).orderBy("timestamp_utc")


def stock_of(asked: DataFrame, stock: DataFrame) -> DataFrame:
    """sku, code, qty of what is asked for: 400 and no quantity for an invalid id, 0 for an unknown one."""
    good = records.valid_product(F.col("sku"))
    joined = asked.join(stock.select("sku", "qty"), "sku", "left")
    return joined.select(*asked.columns, F.when(good, 200).otherwise(400).alias("code"), F.when(good, F.coalesce("qty", F.lit(0))).alias("qty"))
