"""Strategies that guess an incident's window, run over a corpus of post-mortems and scored against its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import seconds_of
from . import ranking, timeseries, windows

def change_points(cases: DataFrame, least: int = 3) -> DataFrame:
    """Change points of every metric of every service as signals: sums of deviations from the series' own mean, for series of
    `least` points or more."""
    series = cases.select("incident_id", F.explode("metrics").alias("service", "of")).select("incident_id", "service", F.explode("of").alias("metric", "points"))
    points = series.filter(F.size("points") >= least).select("incident_id", "service", "metric", F.explode("points").alias("p"))
    points = points.select("incident_id", "service", "metric", seconds_of(F.col("p.t")).alias("t"), F.col("p.v").alias("v")).filter("t is not null and v is not null")
    keys = ["incident_id", "service", "metric"]
    found = timeseries.cusum(points, keys, "t", "v", timeseries.baseline(points, keys, "v"))
    return found.select("incident_id", F.lit("change").alias("kind"), "t", F.lit(None).cast("double").alias("t_end"), F.lit(None).cast("string").alias("severity"), "magnitude")


def signals_of(cases: DataFrame, with_metrics: bool = True) -> DataFrame:
    """The signals (kind, t, t_end, severity, magnitude) of post-mortems."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda kind, t, t_end=none, severity=text: F.struct(F.lit(kind).alias("kind"), t.cast("double").alias("t"), t_end.cast("double").alias("t_end"), severity.alias("severity"), none.alias("magnitude"))
    empty = F.array().cast("array<struct<kind:string,t:double,t_end:double,severity:string,magnitude:double>>")
    every = F.concat(
        F.coalesce(F.transform("vendor", lambda x: row("vendor", x["start"], x["end"], x["severity"])), empty), F.coalesce(F.transform("deploys", lambda x: row("deploy", x)), empty),
        F.coalesce(F.transform("pages", lambda x: row("page", x)), empty), F.transform(windows.text_ranges(F.col("text"), F.col("reported_at")), lambda x: row("text", x["t"], x["t_end"])),
    )
    out = cases.select("incident_id", F.explode(every).alias("s")).select("incident_id", "s.*")
    return out.unionByName(change_points(cases)) if with_metrics else out


def predictions(cases: DataFrame, with_metrics: bool = True) -> DataFrame:
    """One row for each post-mortem and strategy with the window it predicts, null where it has nothing to go by."""
    truth = cases.select("incident_id", "truth_start", "truth_end", "reported_at", "lookback", "pages", "deploys", "vendor")
    simple = ranking.baseline_windows(truth).select("incident_id", "truth_start", "truth_end", "strategy", "start", "end")
    signals = signals_of(cases, with_metrics)
    out = simple
    for name, used in (("selector", signals), ("selector_no_vendor", signals.filter("kind <> 'vendor'"))):
        best = windows.located(used, cases.select("incident_id", "reported_at", "lookback"), most=1).select("incident_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
        out = out.unionByName(truth.select("incident_id", "truth_start", "truth_end").join(best, "incident_id", "left").withColumn("strategy", F.lit(name)))
    return out


def benchmark(cases: DataFrame, with_metrics: bool = True) -> DataFrame:
    """The scoreboard of all strategies."""
    return ranking.scoreboard(ranking.score_windows(predictions(cases, with_metrics)))
