"""Scalar scoring functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cut(value: Column, cuts: list[tuple[float, str]], rest, strict: bool) -> Column:
    out = None
    for least, name in cuts:
        test = value > least if strict else value >= least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def sigma_severity(magnitude: Column) -> Column:
    """By distance in standard deviations."""
    return _cut(magnitude, [(5.0, "CRITICAL"), (3.0, "HIGH"), (2.0, "MEDIUM")], "LOW", strict=False)


def forest_severity(score: Column, is_anomaly: Column) -> Column:
    return _cut(score, [(0.80, "CRITICAL"), (0.65, "HIGH"), (0.55, "MEDIUM")], F.when(is_anomaly, "LOW").otherwise("NORMAL"), strict=True)


def ensemble_severity(score: Column, is_anomaly: Column) -> Column:
    """The upper three grades do not need the anomaly flag."""
    return _cut(score, [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.45, "MEDIUM")], F.when(is_anomaly, "LOW").otherwise("NORMAL"), strict=True)


def reconstruction_severity(error: Column, threshold: Column) -> Column:
    return F.when(error > 2.5 * threshold, "CRITICAL").when(error > 1.5 * threshold, "HIGH").when(error > threshold, "MEDIUM").when(error > 0.8 * threshold, "LOW").otherwise("NORMAL")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search among n points; 0 for one point or none."""
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def tfidf_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs / (1 + df)) + 1


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves of the binary value up, as most languages' round-to-long does."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals (seconds) over the hull of both; 0 for an empty hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / hull).otherwise(0.0)


def beta_interval(p: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a Beta with mean p and n + 2 pseudo-observations, by the normal approximation; (0, 1) without evidence."""
    half = 1.96 * F.sqrt(p * (1 - p) / (n + 3))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), p - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p + half))


def edge_weight(status: Column, duration_ms: Column) -> Column:
    return 1.0 + F.when(status == "error", 2.0).otherwise(0.0) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), duration_ms / 1000.0))
