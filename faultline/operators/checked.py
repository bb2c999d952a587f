"""Checks of records before they are stored, and repairs that say what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what the fields of stored records may be
PHASES = ("intake", "signals", "prior_incident", "fix_and_test")
EVENT_PHASES = (*PHASES, "validator", "orchestrator")
SEVERITIES = ("info", "warn", "error")
FIX_KINDS = ("code", "config", "data", "infra", "spec_gap", "no_fix_needed")
OUTCOMES = ("worked", "partial", "rolled_back", "unknown")
CONFIDENCE = ("high", "medium", "low")


def _one_of(field: str, value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), F.concat(F.lit(f"{field} must be one of {', '.join(sorted(allowed))}, not "), F.coalesce(value, F.lit("null"))))


def _blank(field: str, value: Column) -> Column:
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", f"{field} is empty")


def record_errors(fix_kind: Column, fix_outcome: Column, confidence: Column, pattern: Column) -> Column:
    """What is wrong with a learning record; an outcome and a confidence that are missing have defaults."""
    return F.array_compact(F.array(
        _one_of("fix_kind", fix_kind, FIX_KINDS), _one_of("fix_outcome", F.coalesce(fix_outcome, F.lit("unknown")), OUTCOMES),
        _one_of("confidence", F.coalesce(confidence, F.lit("medium")), CONFIDENCE), _blank("signal_pattern", F.regexp_replace(pattern, r"\s", "")),
    ))


def event_errors(phase: Column, severity: Column, kind: Column) -> Column:
    """What is wrong with a health event."""
    return F.array_compact(F.array(_one_of("phase", phase, EVENT_PHASES), _one_of("severity", severity, SEVERITIES), F.when(F.coalesce(kind, F.lit("")) == "", "event_type is empty")))


def strict(df: DataFrame, errors: Column) -> DataFrame:
    """The rows; one with errors ends the job with the first of them."""
    return df.filter(F.when(F.size(errors) == 0, True).otherwise(F.raise_error(F.get(errors, F.lit(0))).cast("boolean")))


def updated_outcomes(records: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The records with fix_outcome and updated_at of `updates`; an update without a record, or of an unknown outcome, ends
    the job."""
    new = updates.select(key, F.col("fix_outcome").alias("_o"), F.col("updated_at").alias("_u"), F.lit(True).alias("_new"))
    both = records.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    wrong = F.array_compact(F.array(
        F.when(F.col("_old").isNull(), F.concat(F.lit("no learning record for "), F.col(key).cast("string"))), F.when(F.col("_new"), _one_of("fix_outcome", F.col("_o"), OUTCOMES)),
    ))
    return strict(both, wrong).withColumns({"fix_outcome": F.when(F.col("_new"), F.col("_o")).otherwise(F.col("fix_outcome")), "updated_at": F.when(F.col("_new"), F.col("_u")).otherwise(F.col("updated_at"))}).select(*records.columns)


def repaired_trace(result: Column) -> tuple[Column, Column]:
    """(JSON text, warnings) of a trace's result: what is no object becomes {}, and a root failure that is there but no
    object is cleared."""
    value = F.try_parse_json(result)
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    root = F.get_json_object(result, "$.root_failure")
    wrong = is_object(value) & root.isNotNull() & ~root.isin("", "0", "false", "[]", "{}", "0.0") & ~root.startswith("{")
    others = F.map_filter(F.from_json(result, "map<string,string>"), lambda k, v: k != "root_failure")
    warnings = F.array_compact(F.array(F.when(~is_object(value), "the result is no object, taken as empty"), F.when(wrong, "root_failure is no object, cleared")))
    return F.when(~is_object(value), "{}").when(wrong, F.to_json(F.map_concat(others, F.create_map(F.lit("root_failure"), F.lit("{}"))))).otherwise(result), warnings


def missing_keys(required: list[str], present: Column) -> Column:
    """The required keys that are not there, in their order."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)
