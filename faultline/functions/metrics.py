"""Metric values in free text: snapshots of the six features, before and at an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the pattern of each metric, and what its value is divided by
METRICS = {
    "cpu_pct": (r"(?i)cpu[_\s]*(?:usage|percent|pct)?[:\s=]+(\d+(?:\.\d+)?)\s*%?", 100.0),
    "error_rate": (r"(?i)error[_\s]*rate[:\s=]+(\d+(?:\.\d+)?)\s*%?", 100.0),
    "latency_p99": (r"(?i)(?:p99|latency|response)[_\s]*(?:p99)?[:\s=]+(\d+(?:\.\d+)?)\s*ms", 5000.0),
    "throughput": (r"(?i)(?:throughput|rps|req(?:uests)?[/\s]*(?:min|s(?:ec)?))[:\s=]+(\d+(?:\.\d+)?)", 2000.0),
    "mem_pct": (r"(?i)mem(?:ory)?[_\s]*(?:usage|percent|pct)?[:\s=]+(\d+(?:\.\d+)?)\s*%?", 100.0),
    "db_query_ms": (r"(?i)(?:db|database|query)[_\s]*(?:time|latency|avg|ms)?[:\s=]+(\d+(?:\.\d+)?)\s*ms", 3000.0),
}
ARROW = r"(\d+(?:\.\d+)?)[^→>\-\d]*[→>]+[^0-9]*(\d+(?:\.\d+)?)"
#: Metrics that a block needs for a snapshot.
LEAST = 3


def text_blocks(text: Column) -> Column:
    """Parts between empty lines; the lines that are not blank if there is one part only."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parts = F.split(whole, r"\n{2,}")
    return F.when(F.size(parts) > 1, parts).otherwise(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"\S")))


def line_of(block: str, found: str) -> Column:
    """The line of a block in which a text that it holds begins, first occurrence; both are names of columns."""
    before = F.expr(f"substring_index({block}, {found}, 1)")
    return F.concat(F.substring_index(before, "\n", -1), F.substring_index(F.substring(F.col(block), F.length(before) + 1, F.length(block)), "\n", 1))


def share_of_one(value: Column, line: Column) -> Column:
    """An error rate as a share: hundredths where the line has a percent sign or the value is above 1."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.when(line.contains("%") | (value > 1), value / 100.0).otherwise(value)))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with these columns, each made once for a row, however often later steps read it: projections are merged and
    would repeat it, a generator is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def text_snapshots(df: DataFrame, text: str) -> DataFrame:
    """block (0 is the first), label (baseline or incident) and the six features of every snapshot in the text, beside the
    other columns.  A block gives a baseline with three metrics or more; with an arrow also the incident, whose values
    behind arrows go before the others.  Metrics that are missing count 0; values are scaled and at most 1."""
    number = lambda c: F.nullif(c, F.lit("")).cast("double")
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(text_blocks(F.col(text))).alias("block", "_block"))
    rows = _once(rows, {f"_m_{m}": F.nullif(F.regexp_extract("_block", pattern, 0), F.lit("")) for m, (pattern, _) in METRICS.items()})
    # what a pattern has found it finds again in that alone
    rows = _once(rows, {f"_v_{m}": number(F.regexp_extract(f"_m_{m}", pattern, 1)) for m, (pattern, _) in METRICS.items()} | {f"_l_{m}": F.when(F.col(f"_m_{m}").isNotNull(), line_of("_block", f"_m_{m}")) for m in METRICS})
    arrow = lambda line: line.contains("→") | line.contains(">")
    rows = _once(rows, {f"_w_{m}": F.when(arrow(F.col(f"_l_{m}")), number(F.regexp_extract(f"_l_{m}", ARROW, 2))) for m in METRICS})

    def scaled(letter: str, m: str) -> Column:
        v = F.col(f"_{letter}_{m}")
        return share_of_one(v, F.col(f"_l_{m}")) if m == "error_rate" else F.when(v.isNotNull(), F.least(F.lit(1.0), v / METRICS[m][1]))

    rows = _once(rows, {"_shown": F.array(*[scaled("v", m) for m in METRICS]), "_behind": F.array(*[scaled("w", m) for m in METRICS])})
    shown, behind = F.col("_shown"), F.col("_behind")
    merged = F.zip_with(behind, shown, lambda b, a: F.coalesce(b, a))
    there = lambda a: F.size(F.array_compact(a))
    kinds = F.array_compact(F.array(
        F.when(there(shown) >= LEAST, F.struct(F.lit("baseline").alias("label"), shown.alias("values"))),
        F.when((there(behind) > 0) & (there(merged) >= LEAST), F.struct(F.lit("incident").alias("label"), merged.alias("values"))),
    ))
    rows = rows.withColumn("_s", F.explode(kinds))
    return rows.select(*keep, "block", "_s.label", *[F.coalesce(F.get("_s.values", F.lit(k)), F.lit(0.0)).alias(m) for k, m in enumerate(METRICS)])


def filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Sparse records as rows of these features in this order, 0 where one is missing."""
    return df.select(*[c for c in df.columns if c not in names], *[F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(0.0)).cast("double").alias(c) for c in names])
