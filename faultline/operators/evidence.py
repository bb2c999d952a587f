"""Evidence for hypotheses from the signals of an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds after a deployment in which an incident counts as close to it.
RECENT = 7200


def _has(text: str, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(F.coalesce(text, F.lit(""))).contains(w)
    return out


def is_recent(deployed_at: Column, incident_at: Column) -> Column:
    gap = F.coalesce(incident_at, F.lit(0)) - F.coalesce(deployed_at, F.lit(0))
    return (gap > 0) & (gap < RECENT)


# fixed values: of each kind of signal, the evidence that a row gives: when, its name, and its likelihoods if true and if false
def _rules() -> dict[str, list[tuple[Column, str, float, float]]]:
    recent = is_recent(F.col("deployed_at"), F.col("incident_at"))
    return {
        "anomalies": [
            (_has("service", "python", "inventory"), "python_anomaly_signal", 0.8, 0.2), (_has("anomaly_type", "cpu", "memory"), "resource_anomaly", 0.6, 0.3),
            (_has("anomaly_type", "timeout", "network"), "network_anomaly", 0.75, 0.2),
        ],
        "trace": [(_has("service", "python"), "trace_root_python", 0.9, 0.1), (_has("service", "java"), "trace_root_java", 0.85, 0.15)],
        "deploys": [(recent, "recent_deployment", 0.7, 0.3), (~recent, "no_recent_deployment", 0.3, 0.7)],
        "issues": [
            (_has("issue_type", "field", "attribute") & _has("service", "python"), "code_field_mismatch", 0.85, 0.15), (_has("issue_type", "config"), "code_config_error", 0.75, 0.2),
        ],
        "matches": [
            (_has("description", "field"), "kb_field_precedent", 0.75, 0.25), (_has("description", "config"), "kb_config_precedent", 0.7, 0.3), (_has("description", "network"), "kb_network_precedent", 0.8, 0.2),
        ],
    }


def evidence_of(case: str, order: str, **signals: DataFrame) -> DataFrame:
    """case, seq, name, if_true, if_false: what the rows of each kind of signal (anomalies, trace, deploys, issues, matches;
    any may be missing) say, in the order of kinds, then rows, then rules."""
    out = None
    for k, (kind, rules) in enumerate(_rules().items()):
        if signals.get(kind) is None:
            continue
        found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(j).alias("rule"), F.lit(name).alias("name"), F.lit(t).alias("if_true"), F.lit(f).alias("if_false"))) for j, (test, name, t, f) in enumerate(rules)]))
        rows = signals[kind].select(case, F.struct(F.lit(k).alias("kind"), F.col(order).cast("long").alias("o")).alias("_at"), F.explode(found).alias("e"))
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy(case).orderBy("_at", "e.rule")
    return out.select(case, F.row_number().over(w).alias("seq"), "e.name", "e.if_true", "e.if_false")


def first_names(evidence: DataFrame, case: str, most: int = 3) -> DataFrame:
    """supporting, contradicting: the names of each case's first pieces of evidence that are more, and that are less likely
    if true, in order.  They are the same for every hypothesis."""
    side = F.when(F.col("if_true") > F.col("if_false"), "for").when(F.col("if_true") < F.col("if_false"), "against")
    w = Window.partitionBy(case, "_side").orderBy("seq")
    rows = evidence.withColumn("_side", side).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    names = lambda which: F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == which, F.struct("_k", "name")))), lambda x: x["name"])
    return rows.groupBy(case).agg(names("for").alias("supporting"), names("against").alias("contradicting"))


def needs_ensemble(candidates: DataFrame, vendor: DataFrame, case: str, service: str = "service") -> DataFrame:
    """case, needed: whether no candidate service of the case has an anomaly from a vendor."""
    seen = vendor.select(case, service).distinct().withColumn("_v", F.lit(1))
    return candidates.select(case, service).distinct().join(seen, [case, service], "left").groupBy(case).agg((F.count("_v") == 0).alias("needed"))
