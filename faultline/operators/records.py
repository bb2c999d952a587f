"""Validators, repairs, pricing and stores of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import half_up

# fixed values: currency rates to USD, message types, and ranks of outcomes
RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "JPY": 0.0067}
MESSAGE_TYPES = ("order_confirmation", "order_update", "payment_receipt", "shipping_update", "general")
OUTCOMES = ("worked", "partial", "unknown", "rolled_back")


def valid_product(product: Column) -> Column:
    return F.coalesce(product.rlike(r"^[a-zA-Z0-9\-]{1,50}$"), F.lit(False))


def valid_quantity(quantity: Column) -> Column:
    return F.coalesce(quantity.between(1, 10_000), F.lit(False))


def notification_errors(order_id: Column, email: Column, message: Column, kind: Column) -> Column:
    """Every complaint about a notification, in a fixed order."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.length(order_id).between(1, 50), F.lit(False)), "orderId must have 1 to 50 characters"),
        F.when(~F.coalesce(email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False)), "a valid email is required"),
        F.when(F.coalesce(F.length(message) > 5000, F.lit(False)), "message is longer than 5000 characters"),
        F.when(kind.isNotNull() & ~kind.isin(*MESSAGE_TYPES), "unknown type"),
    ))


def repaired_anomalies(df: DataFrame, now: Column) -> DataFrame:
    """Rows (service, description, anomaly, message, timestamp, severity, level, anomaly_type; all nullable) with defaults
    filled in, the type guessed from the description by the first rule that fits, and the warnings."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    text = F.coalesce("description", "anomaly", "message", F.lit("No description"))
    low = F.lower(text)
    guess = (
        F.when(low.contains("400") | low.contains("404") | low.contains("500"), "http_error").when(low.contains("timeout"), "timeout").when(low.contains("latency") | low.contains("slow"), "latency")
        .when(low.contains("memory") | low.contains("cpu"), "resource").otherwise("unknown")
    )
    warnings = F.array_compact(F.array(F.when(none("service"), "missing 'service', set to 'unknown'"), F.when(none("timestamp"), "missing 'timestamp', using current time")))
    return df.withColumns({
        "warnings": warnings, "service": F.when(none("service"), "unknown").otherwise(F.col("service")), "description": text, "timestamp": F.when(none("timestamp"), now).otherwise(F.col("timestamp")),
        "severity": F.coalesce("severity", "level", F.lit("WARN")), "anomaly_type": F.coalesce(F.col("anomaly_type"), guess),
    })


def sanity(df: DataFrame, required: dict[str, str], optional: list[str]) -> DataFrame:
    """Adds signal_count, healthy (two or more signals) and issues; the columns are truth values of signal sources, and
    `required` gives the issue of each one whose absence is one."""
    columns = [*required, *optional]
    count = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in columns), F.lit(0))
    issues = F.array_compact(F.array(
        F.when(count < 2, F.concat(F.lit("CRITICAL: only "), count.cast("string"), F.lit(f"/{len(columns)} sources gave results"))), *[F.when(~F.coalesce(F.col(c), F.lit(False)), text) for c, text in required.items()]
    ))
    return df.withColumns({"signal_count": count, "healthy": count >= 2, "issues": issues})


def to_usd(amount: Column, currency: Column) -> Column:
    rate = None
    for code, r in RATES.items():
        rate = F.when(F.upper(F.trim(currency)) == code, r) if rate is None else rate.when(F.upper(F.trim(currency)) == code, r)
    return amount * rate.otherwise(F.raise_error(F.concat(F.lit("unknown currency: "), F.coalesce(currency, F.lit("null")))).cast("double"))


def coupon_valid(active: Column, kind: Column, value: Column, minimum: Column, subtotal: Column) -> Column:
    by_kind = F.when(kind == "PERCENTAGE", value <= 100).when(kind == "FIXED", value < subtotal).otherwise(False)
    return F.coalesce(active & (subtotal >= minimum) & (value > 0) & by_kind, F.lit(False))


def order_total(subtotal: Column, kind: Column, value: Column) -> Column:
    """Subtotal less a percentage or a fixed amount, not below zero, to the cent."""
    return half_up(F.greatest(F.lit(0.0), F.when(kind == "PERCENTAGE", subtotal * (1 - value / 100.0)).when(kind == "FIXED", subtotal - value).otherwise(subtotal)))


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last record written of each key: whole records replace each other."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")


def find_records(df: DataFrame, pattern: str | None = None, kind: str | None = None, outcome: str | None = None) -> DataFrame:
    """Filtered by a part of the pattern (any letter case), kind and outcome, each if given; best outcomes first, then newest."""
    if pattern:
        df = df.filter(F.lower("pattern").contains(pattern.lower()))
    if kind:
        df = df.filter(F.col("fix_kind") == kind)
    if outcome:
        df = df.filter(F.col("fix_outcome") == outcome)
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("fix_outcome"))
    return df.withColumn("outcome_rank", F.when(rank > 0, rank - 1).otherwise(9)).orderBy("outcome_rank", F.desc("recorded_at"))


def summarise_records(df: DataFrame) -> DataFrame:
    """Counts by kind, by outcome, by pattern (with the share that worked) and in all, in one pass over grouping sets."""
    return (
        df.groupingSets([["fix_kind"], ["fix_outcome"], ["pattern"], []], "fix_kind", "fix_outcome", "pattern")
        .agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("fix_outcome") == "worked").alias("worked"))
        .withColumn("rate", F.round(F.col("worked") / F.col("n"), 6))
    )


def health_status(events: DataFrame, key: str) -> DataFrame:
    """Counts by severity of each incident, and the exit status: 2 with errors, 1 with warnings only, else 0."""
    out = events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))
    return out.withColumn("status", F.when(F.col("errors") > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0))


def hydrate(comments: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Of each issue, the newest comment's first payload between the marks that decodes and whose diff has the pinned
    SHA-256 (or no pin or diff); status 0 found, 1 no payload, 2 none decodes, 3 none passes the pin."""
    raw = F.explode_outer(F.regexp_extract_all("body", F.lit(rf"(?s){start}\s*(.*?)\s*{end}"), F.lit(1)))
    rows = comments.select(key, "id", "created_at", raw.alias("raw")).withColumn("raw", F.regexp_replace("raw", r"\s", ""))
    bytes_ = F.try_to_binary(F.col("raw"), F.lit("base64"))
    text = F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string"))
    rows = rows.withColumn("payload", F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), text))
    diff, pin = F.get_json_object("payload", "$.diff"), F.get_json_object("payload", "$.diff_sha256")
    rows = rows.withColumn("pinned", F.col("payload").isNotNull() & (diff.isNull() | pin.isNull() | (F.sha2(F.encode(diff, "UTF-8"), 256) == pin)))
    w = Window.partitionBy(key).orderBy(F.desc("pinned"), F.desc("created_at"), F.desc("id"))
    best = rows.withColumn("rn", F.row_number().over(w)).withColumn("any_raw", F.max(F.col("raw").isNotNull()).over(Window.partitionBy(key))).withColumn("any_ok", F.max(F.col("payload").isNotNull()).over(Window.partitionBy(key)))
    status = F.when(F.col("pinned"), 0).when(~F.col("any_raw"), 1).when(~F.col("any_ok"), 2).otherwise(3)
    return best.filter("rn = 1").select(key, status.alias("status"), F.when(F.col("pinned"), F.col("id")).alias("comment_id"), F.when(F.col("pinned"), F.col("payload")).alias("payload"))


def new_keys(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requests whose key is not stored yet, each key once."""
    return incoming.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")
