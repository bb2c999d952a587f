"""Contracts between phases: repair of their results, routing of tickets, contradictions, payloads, requests and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: for each kind of result, the fields of an item, where each is taken from in order, and its default
APM_ITEM = {"service": (("service",), "unknown"), "severity": (("severity",), "MEDIUM")}
CODE_ITEM = {
    "description": (("description", "message", "title"), "No description"), "severity": (("severity",), "MEDIUM"), "service": (("service", "file"), "unknown"),
}
#: Longest comment that can be posted, and largest request body.
COMMENT_CHARS, BODY_BYTES = 65_536, 1 << 20


def repaired_items(items: Column, fields: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """An array of structs with its missing fields filled in; a null array becomes an empty one."""
    fill = lambda a: F.struct(*[F.coalesce(*[a[c] for c in sources], F.lit(default)).alias(k) for k, (sources, default) in fields.items()])
    return F.coalesce(F.transform(items, fill), F.array())


def repaired_hypotheses(ranked: Column, other: Column | None = None) -> Column:
    """Structs (description, hypothesis, confidence), from `other` where `ranked` is null; an item without either text is
    named by its place, and a missing confidence is 0.5."""

    def fill(h: Column, i: Column) -> Column:
        named = F.when(h["hypothesis"].isNull(), F.concat(F.lit("Hypothesis "), (i + 1).cast("string")))
        return F.struct(F.coalesce(h["description"], named).alias("description"), h["hypothesis"].alias("hypothesis"), F.coalesce(h["confidence"], F.lit(0.5)).alias("confidence"))

    return F.coalesce(F.transform(ranked if other is None else F.coalesce(ranked, other), fill), F.array())


def repaired_deploys(verdict: Column, suspicious: Column) -> tuple[Column, Column]:
    """The verdict, unknown if missing, and the list of suspicious deployments, empty if missing."""
    return F.coalesce(verdict, F.lit("unknown")), F.coalesce(suspicious, F.array())


def repaired_matches(matches: Column, lessons: Column) -> tuple[Column, Column]:
    """Lists of matches and lessons of the knowledge base, empty if missing."""
    return F.coalesce(matches, F.array()), F.coalesce(lessons, F.array())


def routed(tickets: DataFrame, terms: DataFrame, key: str, text: str, margin: float = 0.1) -> DataFrame:
    """The best service of each ticket: key, service, score, needs_disambiguation.

    `terms` (service, term, weight) holds the literal names and synonyms; the words of a ticket meet them by equality, and
    the score is 1 - product(1 - weight) over the distinct terms met.  A ticket that meets none, or whose second service
    is less than `margin` behind, needs disambiguation.  Ties go to the first name.
    """
    words = tickets.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0)))).alias("term"))
    scores = words.join(terms, "term").groupBy(key, "service").agg((1 - F.product(1 - F.col("weight"))).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "service")
    best = scores.withColumns({"_k": F.row_number().over(w), "_next": F.lead("score").over(w)}).filter("_k = 1")
    unsure = F.col("service").isNull() | F.coalesce(F.col("score") - F.col("_next") < margin, F.lit(False))
    return tickets.select(key).join(best, key, "left").select(key, "service", "score", unsure.alias("needs_disambiguation"))


def contradictions(files: DataFrame, signalled: DataFrame, key: str) -> DataFrame:
    """Blocking warnings (key, file, warning) for changed files (key, file) whose first path part is no service of
    `signalled` (key, service)."""
    named = files.select(key, "file", F.substring_index("file", "/", 1).alias("service")).distinct()
    outside = named.join(signalled.select(key, "service").distinct(), [key, "service"], "left_anti")
    return outside.select(key, "file", F.concat(F.lit("contradiction: "), "file", F.lit(" lies outside the services with signals")).alias("warning"))


def env_references(text: Column) -> Column:
    """The distinct names in ${NAME}, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([A-Z0-9_]+)\}"), F.lit(1))))


def encoded_payload(preamble: Column, payload: Column, start: str, end: str) -> tuple[Column, Column]:
    """The comment that carries a JSON payload between marks, and whether it can be posted."""
    body = F.concat(preamble, F.lit("\n" + start + "\n"), F.base64(F.encode(payload, "UTF-8")), F.lit("\n" + end))
    return body, F.length(body) <= COMMENT_CHARS


def request_body(raw: Column, most: int = BODY_BYTES) -> tuple[Column, Column]:
    """(status, body) of a request: too_large, invalid or ok; an empty body is {}."""
    whole = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.lit("{}")).otherwise(raw)
    status = F.when(F.octet_length(whole) > most, "too_large").when(F.try_parse_json(whole).isNull(), "invalid").otherwise("ok")
    return status, F.when(status == "ok", whole)


def health_line(severity: Column, at: Column, incident: Column, phase: Column, kind: Column, details: Column) -> Column:
    """One line of an event; details are JSON."""
    padded = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    known = lambda c: F.coalesce(c, F.lit("?"))
    tag = F.when(severity == "info", "  ").when(severity == "warn", "WW").when(severity == "error", "EE").otherwise("??")
    return F.concat_ws("  ", tag, known(at), padded(known(incident), 15), padded(known(phase), 14), known(kind), F.coalesce(details, F.lit("{}")))


def page(df: DataFrame, order: list, limit: str | int | None = None, offset: int = 0) -> DataFrame:
    """One page of rows in their order; a limit that is no number or below 1 is 50, one above 100 is 100."""
    try:
        size = int(limit)
    except (TypeError, ValueError):
        size = 50
    return df.orderBy(*order).offset(max(0, offset)).limit(50 if size < 1 else min(100, size))


def newest(df: DataFrame, order: list, most: int = 10_000) -> DataFrame:
    """A buffer's last rows: at most `most`, the oldest dropped."""
    return df.orderBy(*order).limit(most)


def with_outcomes(records: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Records with fix_outcome and updated_at of `updates` (key, fix_outcome, updated_at; one row for each key)."""
    new = updates.select(key, F.col("fix_outcome").alias("_o"), F.col("updated_at").alias("_u"))
    joined = records.join(new, key, "left")
    return joined.withColumns({"fix_outcome": F.coalesce("_o", "fix_outcome"), "updated_at": F.coalesce("_u", "updated_at")}).select(*records.columns)
