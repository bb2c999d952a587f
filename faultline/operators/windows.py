"""Where an incident lies in time: evidence of five kinds becomes scored half hours, with what is known about their worth.

A piece of evidence adds w * exp(-z^2 / 2) at a window's middle, z being the distance from the evidence in widths of its own
side; 1 - exp(-sum) is the confidence.  So -sum is the logarithm of the probability that every piece missed, pieces add up,
and more evidence never lowers a confidence.  Weights and widths are of our own design, except the severities' weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("vendor", "change", "deploy", "page", "text")
# fixed values: weights of a vendor anomaly by severity
SEVERITY = {"CRITICAL": 1.3, "HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
#: Minutes before and after that a piece of evidence reaches, as widths; a vendor anomaly's grows with its span up to the last.
WIDTHS = {"change": (10, 10), "deploy": (2, 25), "page": (20, 5)}
VENDOR_LEAST, VENDOR_RIGHT, VENDOR_MOST = 10, 5, 25
WEIGHTS = {"deploy": 0.6, "page": 0.6, "text": 0.4}
#: Deviations beyond which a change point counts no more.
MOST_SIGMA = 20.0
#: Below this confidence a user should stop; without pages it is no more than the second.
STOP, WITHOUT_PAGES = 0.4, 0.8
NO_EVIDENCE = "no_evidence_available"
# phrases of a ticket and the hours of its day, in UTC, that they stand for
ANCHORS = (("last night", -6, 0), ("overnight", 0, 6), ("this morning", 6, 12), ("after lunch", 12, 15), ("this afternoon", 12, 18), ("this evening", 18, 24), ("tonight", 18, 24))
CLOCK = r"\bat (\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
STEP, HALF = 300, 900


def text_ranges(text: Column, reported_at: Column) -> Column:
    """(t, t_end) of each time that a ticket names, in seconds: phrases of the day, and half an hour around a clock time."""
    low, day = F.lower(F.coalesce(text, F.lit(""))), F.floor(reported_at / 86400) * 86400
    span = lambda a, b: F.struct((day + a).cast("long").alias("t"), (day + b).cast("long").alias("t_end"))
    hour = F.regexp_extract(low, CLOCK, 1).cast("int") % 12 + F.when(F.regexp_extract(low, CLOCK, 3) == "pm", 12).otherwise(0)
    at = hour * 3600 + F.coalesce(F.nullif(F.regexp_extract(low, CLOCK, 2), F.lit("")).cast("int"), F.lit(0)) * 60
    found = [F.when(low.contains(phrase), span(3600 * a, 3600 * b)) for phrase, a, b in ANCHORS] + [F.when(low.rlike(CLOCK), span(at - 1800, at + 1800))]
    return F.array_compact(F.array(*found))


def evidence_of(signals: DataFrame) -> DataFrame:
    """key columns kept, with t, t_end, w, s_left, s_right (seconds) of signals (kind, t, t_end, severity, magnitude).
    Unknown kinds and severities, and signals without a time, are left out."""
    kind, span = F.col("kind"), F.coalesce(F.col("t_end") - F.col("t"), F.lit(0)) / 60
    weight = F.when(kind == "change", 0.9 * F.least(F.abs("magnitude"), F.lit(MOST_SIGMA)) / MOST_SIGMA + 0.1)
    for name, w in SEVERITY.items():
        weight = weight.when((kind == "vendor") & (F.upper("severity") == name), w)
    left = F.when(kind == "vendor", F.least(F.lit(float(VENDOR_MOST)), F.greatest(F.lit(float(VENDOR_LEAST)), span / 2)))
    right = F.when(kind == "vendor", F.lit(float(VENDOR_RIGHT)))
    for name, w in WEIGHTS.items():
        weight = weight.when(kind == name, w)
    for name, (a, b) in WIDTHS.items():
        left, right = left.when(kind == name, float(a)), right.when(kind == name, float(b))
    rows = signals.withColumns({"w": weight, "s_left": left * 60, "s_right": right * 60, "t_end": F.when(kind == "text", F.col("t_end")).otherwise(F.col("t"))})
    rows = rows.withColumns({"s_left": F.coalesce("s_left", F.lit(1.0)), "s_right": F.coalesce("s_right", F.lit(1.0))})  # a named range ends sharply
    return rows.filter("w is not null and t is not null").drop("severity", "magnitude")


def scored_slots(evidence: DataFrame, incidents: DataFrame, key: str) -> DataFrame:
    """key, slot (its middle in steps), confidence and the number of pieces of each kind that bear on it, for every slot of the
    lookback that some evidence reaches.  Evidence is dealt to the slots within six widths and within the lookback, so a
    piece makes no more rows than an incident has slots."""
    first = F.ceil((F.col("reported_at") - F.col("lookback") + HALF) / STEP)
    last = F.floor((F.col("reported_at") - HALF) / STEP)
    near = evidence.join(incidents.select(key, "reported_at", "lookback", "pages_missing"), key)
    near = near.withColumn("_lo", F.greatest(first, F.floor((F.col("t") - 6 * F.col("s_left")) / STEP))).withColumn("_hi", F.least(last, F.ceil((F.col("t_end") + 6 * F.col("s_right")) / STEP)))
    near = near.filter("_lo <= _hi").withColumn("slot", F.explode(F.sequence("_lo", "_hi")))
    m = F.col("slot") * STEP
    z = F.when(m < F.col("t"), (F.col("t") - m) / F.col("s_left")).when(m > F.col("t_end"), (m - F.col("t_end")) / F.col("s_right")).otherwise(0.0)
    near = near.withColumn("_k", F.exp(-0.5 * z * z))
    counts = [F.count_if((F.col("kind") == k) & (F.col("_k") >= 0.1)).alias(f"n_{k}") for k in KINDS]
    rows = near.groupBy(key, "pages_missing", "slot").agg(F.sum(F.col("w") * F.col("_k")).alias("_score"), *counts)
    confidence = F.round(1 - F.exp(-F.col("_score")), 6)
    return rows.withColumn("confidence", F.when(F.col("pages_missing"), F.least(F.lit(WITHOUT_PAGES), confidence)).otherwise(confidence)).drop("_score", "pages_missing")


def best_windows(slots: DataFrame, key: str, most: int = 3) -> DataFrame:
    """rank, start, end, confidence and counts of the `most` best half hours of each incident that do not overlap; the first
    of equals goes before.  An incident has no more slots than its lookback, so its list is bounded."""
    counts = [f"n_{k}" for k in KINDS]
    entry = F.struct((-F.col("confidence")).alias("c"), "slot", *counts)
    rows = slots.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("ws"))
    kind = dict(rows.dtypes)["ws"]
    apart = 2 * HALF // STEP
    pick = F.aggregate("ws", F.array().cast(kind), lambda a, x: F.when((F.size(a) < most) & ~F.exists(a, lambda y: F.abs(y["slot"] - x["slot"]) < apart), F.concat(a, F.array(x))).otherwise(a))
    out = rows.select(key, F.posexplode(pick).alias("pos", "x"))
    return out.select(key, (F.col("pos") + 1).cast("long").alias("rank"), (F.col("x.slot") * STEP - HALF).cast("long").alias("start"), (F.col("x.slot") * STEP + HALF).cast("long").alias("end"), (-F.col("x.c")).alias("confidence"), *[F.col(f"x.{c}").alias(c) for c in counts])


def located(signals: DataFrame, incidents: DataFrame, key: str = "incident_id", most: int = 3) -> DataFrame:
    """best_windows of incidents (reported_at, lookback in seconds) from their signals; an incident is capped at
    `WITHOUT_PAGES` if none of its signals is a page."""
    paged = signals.filter("kind = 'page' and t is not null").select(key).distinct().withColumn("_paged", F.lit(True))
    known = incidents.join(paged, key, "left").withColumn("pages_missing", F.col("_paged").isNull()).drop("_paged")
    return best_windows(scored_slots(evidence_of(signals), known, key), key, most)


def coverage(windows: DataFrame, signals: DataFrame, incidents: DataFrame, key: str = "incident_id") -> DataFrame:
    """Of each incident: n_windows, the best confidence (0 without a window), pages_missing, coverage_warning, and `stop`: the
    confidence is below `STOP`, so nobody should go on with a guessed window."""
    found = windows.groupBy(key).agg(F.count("*").alias("n_windows"), F.max("confidence").alias("_best"))
    paged = signals.filter("kind = 'page' and t is not null").select(key).distinct().withColumn("_paged", F.lit(True))
    rows = incidents.select(key).join(found, key, "left").join(paged, key, "left")
    best = F.coalesce("_best", F.lit(0.0))
    return rows.select(key, F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), best.alias("confidence"), F.col("_paged").isNull().alias("pages_missing"), F.when(F.col("n_windows").isNull(), NO_EVIDENCE).alias("coverage_warning"), (best < STOP).alias("stop"))
