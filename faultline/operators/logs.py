"""Log and span text: blocks, fields, anomaly classes, contract violations between services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import to_camel, to_snake

# fixed values: patterns of log fields
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
LEVEL = r"(?i)\b(ERROR|WARN(?:ING)?|INFO|DEBUG|FATAL|CRITICAL|TRACE)\b"
METHOD = r"\b(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b"
STATUS = r"\b([1-5]\d{2})\b"
URL = r"(https?://[^\s\"']+|/[a-zA-Z0-9/_-]+(?:\?[^\s\"']*)?)"
BODY = r"\{[^{}]*\}"
JSON_KEY = r"\"([a-zA-Z_][a-zA-Z0-9_]*)\":\s*(?:\"[^\"]*\"|[\d.]+|true|false|null)"
MISSING = r"[Mm]issing\s+(?:required\s+)?field[:\s]+[\"']?([a-zA-Z_][a-zA-Z0-9_]*)[\"']?"
KEY_ERROR = r"KeyError:\s*['\"]([^'\"]+)['\"]"
RECEIVED = r"(?i)received\s+(?:keys?|fields?):\s*\[([^\]]+)\]"
EXCEPTION = r"([A-Z][a-zA-Z]*(?:Exception|Error|Failure)(?:\.[A-Z][a-zA-Z]*)?)"
AMOUNT = r"\$?([\d]+\.[\d]{2})\b"
LATENCY = r"(\d+)\s*ms\b"
# fixed values: anomaly classes, the first that matches counts
CLASSES = [
    (r"(?i)KeyError|missing\s+(?:required\s+)?field|MissingField", "field_mismatch", "ERROR"),
    (r"(?i)ClassCastException|cannot cast|type\s+mismatch", "type_error", "ERROR"),
    (r"(?i)stored\s+\d+\s+(?:expected|should be)\s+[\d.]+", "type_error", "ERROR"),
    (r"(?i)HTTP\s+400|400\s+Bad\s+Request", "field_mismatch", "ERROR"),
    (r"(?i)stock\s*[><=]+\s*(?:quantity|qty)|off[- ]by[- ]one", "boundary_condition", "WARN"),
    (r"(?i)\"PERCENT(?!AGE)\"", "string_mismatch", "ERROR"),
    (r"(?i)rate.*0\.1\d{2}|0\.1\d{2}.*rate", "rate_error", "ERROR"),
    (r"(?i)NullPointerException|null\s+pointer", "null_error", "ERROR"),
    (r"(?i)Connection\s+(?:refused|timed?\s+out)|timeout", "connectivity", "ERROR"),
]
SPAN = r"(?i)[Ss]pan\s*(\d+)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(\d+)\s*ms?\s*\|\s*(OK|ERROR|TIMEOUT)(?:\s*→\s*(.+))?$"


#: Line numbers of one stretch of a log, which one task numbers.
STRETCH = 1 << 13


def blocks(lines: DataFrame, keys: list[str], order: str, line: str, stretch: int = STRETCH) -> DataFrame:
    """One row for each entry of a log: lines that start with no timestamp, level or "[20" belong to the entry above.

    A log is numbered in stretches of its line numbers: the entries that begin before a stretch are counted first, so the
    lines of one service are not sorted in one task.
    """
    begins = F.col(line).rlike(rf"^(?:{TIMESTAMP}|(?i:ERROR|WARN|INFO|DEBUG|FATAL|CRITICAL|TRACE)\b|\[20)")
    marked = lines.select(*keys, F.col(order).alias("_o"), F.col(line).alias("_l"), F.floor(F.col(order) / stretch).alias("_s"), begins.cast("long").alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_s")
    before = marked.groupBy(*keys, "_s").agg(F.sum("_b").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    within = F.sum("_b").over(Window.partitionBy(*keys, "_s").orderBy("_o"))
    numbered = marked.withColumn("_k", within).join(before, [*keys, "_s"]).withColumn("block", F.col("_before") + F.col("_k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_l").alias("l")))), lambda x: x["l"]), "\n")
    return numbered.groupBy(*keys, "block").agg(text.alias("raw"), F.count("*").alias("n_lines"))


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _first(text: Column, pattern: str, group: int = 1, needed: Column | None = None) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return found if needed is None else F.when(needed, found)


#: Of each class, lower-case parts of which a text that matches has at least one.
CLASS_PARTS = (("keyerror", "missing", "missingfield"), ("cast", "mismatch"), ("stored",), ("400",), ("stock", "off"), ('"percent"',), ("0.1",), ("null",), ("connection", "timeout"))


def classified(text: Column) -> tuple[Column, Column]:
    """(type, severity) of the first class that matches; null if none does."""
    kind = severity = None
    low = F.lower(text)
    for (pattern, name, level), parts in zip(CLASSES, CLASS_PARTS, strict=True):
        test = _has(low, *parts) & text.rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        severity = F.when(test, level) if severity is None else severity.when(test, level)
    return kind, severity


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the fields of each entry.  The status is the last three-digit number from 100 to 599, whatever it stands for."""
    t = F.col(raw)
    none = F.array().cast("array<string>")
    every = lambda p, needed, g=1: F.when(needed, F.regexp_extract_all(t, F.lit(p), F.lit(g))).otherwise(none)
    has = lambda *parts: _has(t, *parts)
    kind, severity = classified(t)
    missing = F.concat(every(MISSING, has("issing")), every(KEY_ERROR, has("KeyError")))
    received = F.transform(F.split(_first(t, RECEIVED, needed=has("[")), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    status = F.try_element_at(F.regexp_extract_all(t, F.lit(STATUS), F.lit(1)), F.lit(-1)).cast("int")
    out = df.withColumns({
        "log_ts": _first(t, TIMESTAMP, 0), "level": F.upper(_first(t, LEVEL)), "method": _first(t, METHOD), "status": status, "url": _first(t, URL, needed=has("/")),
        "bodies": every(BODY, has("{"), 0), "missing_fields": missing, "received_keys": F.coalesce(received, F.array().cast("array<string>")), "exceptions": every(EXCEPTION, has("Exception", "Error", "Failure")),
        "amounts": F.transform(every(AMOUNT, has(".")), lambda x: x.cast("double")), "latencies": F.transform(every(LATENCY, has("ms")), lambda x: x.cast("long")), "anomaly_type": kind, "anomaly_severity": severity,
    })
    parts = [
        F.when(F.size("missing_fields") > 0, F.concat(F.lit("Missing fields: "), F.array_join(F.array_sort(F.array_distinct("missing_fields")), ", "))),
        F.when(F.size("exceptions") > 0, F.concat(F.lit("Exception: "), F.element_at("exceptions", 1))), F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))),
    ]
    return out.withColumn("description", F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.substring(raw, 1, 120)))


def totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each log; FATAL and CRITICAL are in no level count."""
    return entries.groupBy(*keys).agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("level") == "ERROR").alias("n_errors"), F.count_if(F.col("level").isin("WARN", "WARNING")).alias("n_warnings"),
        F.count_if(F.col("status") >= 400).alias("n_http_errors"), F.count_if(F.col("anomaly_type").isNotNull()).alias("n_anomalies"),
    )


def contract_violations(entries: DataFrame, service: str = "service") -> DataFrame:
    """Fields that one service misses and another sends, exactly (0.95) or in the other letter case style (0.97)."""
    missing = entries.select(F.col(service).alias("receiver"), F.explode("missing_fields").alias("field")).distinct()
    sent = entries.select(F.col(service).alias("sender"), F.explode(F.flatten(F.transform("bodies", lambda b: F.regexp_extract_all(b, F.lit(JSON_KEY), F.lit(1))))).alias("sent")).distinct()
    exact = missing.join(sent, F.col("field") == F.col("sent")).withColumn("confidence", F.lit(0.95)).withColumn("kind", F.lit("exact"))
    other = missing.withColumn("variant", F.explode(F.array_except(F.array_distinct(F.array(to_camel(F.col("field")), to_snake(F.col("field")))), F.array("field"))))
    case = other.join(sent, F.col("variant") == F.col("sent")).drop("variant").withColumn("confidence", F.lit(0.97)).withColumn("kind", F.lit("case"))
    both = exact.unionByName(case)
    return both.groupBy("field", "sent", "kind", "confidence").agg(F.array_sort(F.collect_set("receiver")).alias("receivers"), F.array_sort(F.collect_set("sender")).alias("senders"))


def spans(df: DataFrame, line: str) -> DataFrame:
    """Rows that are span lines, with service, operation (up to the first bracket), duration, status and detail."""
    t = F.col(line)
    part = lambda g: F.regexp_extract(t, SPAN, g)
    return df.filter(t.rlike(SPAN)).withColumns({
        "span_no": part(1).cast("long"), "service": F.trim(part(2)), "operation": F.trim(F.substring_index(part(3), "(", 1)), "duration_ms": part(4).cast("long"), "status": F.lower(part(5)),
        "detail": F.nullif(part(6), F.lit("")), "http_status": F.nullif(F.regexp_extract(part(6), r"HTTP\s+(\d{3})", 1), F.lit("")).cast("int"),
    })
