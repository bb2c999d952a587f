"""Density clusters of alerts.

Positions lie in [0, weight] in each direction, so a grid of cells with half the radius as side has a number of cells that
depends on the radius alone, however many alerts there are.  Alerts of one cell are within the radius of each other: a cell
with enough of them is one piece of a cluster, and only the few alerts of thin cells are compared one by one.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Weights of time, service, anomaly type and severity, and the severities' numbers (1 if unknown).
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}

#: Slack of the squared radius, for distances equal to it.
SLACK = 1e-15
#: Least radius: the grid has fewer than 300,000 cells.
LEAST_EPS = 0.02


def _key(*columns: str) -> Column:
    """A string that is equal for equal values, nulls included."""
    return F.to_json(F.struct(*columns))


def _positions(alerts: DataFrame, group: str, side: float) -> DataFrame:
    """The alerts with _g (key of the group), _x (position, scaled to [0, 1] in the group, times the weights) and _cell."""
    known = F.create_map(*[F.lit(v) for pair in SEVERITY.items() for v in pair])
    out = alerts.withColumns(
        {
            "_g": _key(group),
            "_v0": F.coalesce(F.col("ts").cast("double"), F.lit(0.0)),
            "_v3": F.coalesce(known[F.lower("severity")], F.lit(1)).cast("double"),
            "_service": _key("service"),
            "_anomaly_type": _key("anomaly_type"),
        }
    )
    for column, code in (("_service", "_v1"), ("_anomaly_type", "_v2")):
        w = Window.partitionBy("_g").orderBy("_first", column)
        seen = out.groupBy("_g", column).agg(F.min("ord").alias("_first"))
        out = out.join(seen.select("_g", column, (F.row_number().over(w) - 1).cast("double").alias(code)), ["_g", column])
    ends = [f(f"_v{k}").alias(f"_{name}{k}") for k in range(4) for name, f in (("low", F.min), ("high", F.max))]
    out = out.join(out.groupBy("_g").agg(*ends), "_g")
    x = []
    for k, weight in enumerate(WEIGHTS):
        v, low, high = (F.col(f"_{n}{k}") for n in ("v", "low", "high"))
        x.append(F.when(high > low, (v - low) / (high - low)).otherwise(0.0) * weight)
    out = out.withColumn("_x", F.array(*x)).withColumn("_cell", F.array(*[F.floor(F.col("_x")[k] / side).cast("int") for k in range(4)]))
    return out.select(*alerts.columns, "_g", "_x", "_cell")


def _square(x: str, y: str, first: int = 0) -> Column:
    """Squared distance, over the directions from `first` on."""
    return functools.reduce(Column.__add__, [F.pow(F.col(x)[k] - F.col(y)[k], 2) for k in range(first, 4)])


def _near(cells: DataFrame) -> DataFrame:
    """g, cell, to: each cell of the grid with those, itself included, that can hold something within the radius (two sides)."""
    other = cells.select("g", F.col("cell").alias("to"), F.col("cell")[0].alias("t"))
    pairs = cells.select("g", "cell", F.explode(F.sequence(F.col("cell")[0] - 3, F.col("cell")[0] + 3)).alias("t")).join(other, ["g", "t"])
    steps = [F.greatest(F.abs(F.col("to")[k] - F.col("cell")[k]) - 1, F.lit(0)) for k in range(4)]
    return pairs.filter(functools.reduce(Column.__add__, [s * s for s in steps]) <= 4).drop("t")


def _links(core: DataFrame, near: DataFrame, eps: float, side: float) -> DataFrame:
    """g, cell, to: pairs of cells with core positions within the radius of each other.

    Positions with equal service, type and severity differ in time alone, so their least and greatest times decide between
    cells of different times; within the same time the nearest pair is looked for only where the rest is nearly a radius
    apart, among times cut into stretches as long as the gap allowed.
    """
    reach = eps * eps + SLACK
    rest = F.slice("x", 2, 3)
    slots = core.groupBy("g", "cell", rest.alias("rest")).agg(F.min(F.col("x")[0]).alias("lo"), F.max(F.col("x")[0]).alias("hi"))
    slots = slots.withColumn("y", F.concat(F.array(F.lit(0.0)), "rest"))
    other = slots.select("g", F.col("cell").alias("to"), *[F.col(c).alias(f"{c}2") for c in ("rest", "lo", "hi", "y")])
    pairs = slots.join(near.filter("cell < to"), ["g", "cell"]).join(other, ["g", "to"]).withColumn("apart", _square("y", "y2", 1)).filter(F.col("apart") <= reach)
    gap = F.when(F.col("cell")[0] == F.col("to")[0], side).otherwise(F.greatest(F.col("lo2") - F.col("hi"), F.col("lo") - F.col("hi2")))
    linked = pairs.filter(gap * gap + F.col("apart") <= reach).select("g", "cell", "to").distinct()

    unsure = pairs.filter((F.col("cell")[0] == F.col("to")[0]) & (side * side + F.col("apart") > reach)).join(linked, ["g", "cell", "to"], "left_anti")
    unsure = unsure.withColumn("most", F.sqrt(reach - F.col("apart"))).filter("most > 0")
    names = ["g", "cell", "rest", "to", "rest2", "apart", "most"]
    at = core.select("g", "cell", rest.alias("rest"), F.col("x")[0].alias("time"))

    def stretches(cell: str, kind: str) -> DataFrame:
        times = unsure.select(*names).join(at.select("g", F.col("cell").alias(cell), F.col("rest").alias(kind), "time"), ["g", cell, kind])
        return times.groupBy(*names, F.floor(F.col("time") / F.col("most")).alias("k")).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))

    a = stretches("cell", "rest").withColumn("k2", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    b = stretches("to", "rest2").withColumnsRenamed({"k": "k2", "lo": "lo2", "hi": "hi2"})
    gap = F.greatest(F.col("lo2") - F.col("hi"), F.col("lo") - F.col("hi2"))
    close = a.join(b, [*names, "k2"]).filter((F.col("k") == F.col("k2")) | (gap * gap + F.col("apart") <= reach))
    return linked.union(close.select("g", "cell", "to").distinct())


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters of the linked cells of one group, numbered by their first core alert; the grid bounds the number of rows."""
    up: dict[tuple, tuple] = {}

    def top(c: tuple) -> tuple:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    rows = [(tuple(a), tuple(b), o) for a, b, o in pdf[["cell", "to", "ord"]].itertuples(index=False)]
    first = {a: int(o) for a, b, o in rows if a == b}
    up.update({c: c for c in first})
    for a, b, _ in rows:
        a, b = sorted((top(a), top(b)), key=first.__getitem__)
        up[b] = a
    number = {c: k for k, c in enumerate(sorted({top(c) for c in first}, key=lambda c: (first[c], c)))}
    out = [(pdf["g"].iloc[0], list(c), number[top(c)], first[top(c)]) for c in first]
    return pd.DataFrame(out, columns=["g", "cell", "cluster", "start"])


def cluster_alerts(alerts: DataFrame, group: str, eps: float = 0.5, least: int = 2) -> DataFrame:
    """The alerts (alert_id, ord, ts in seconds, service, anomaly_type, severity) with their cluster in their group; -1 is noise.

    Distance is sqrt(sum (weight * difference)^2) of values scaled to [0, 1] in the group; a core alert has `least` alerts
    within eps, itself included.  Clusters count from 0 by their first core alert.  An alert that is not core belongs to the
    last cluster whose first core alert is within eps, or else to the first one with any core alert within eps.  A null time
    counts as 0, a null service, type or group as a value of its own, an unknown severity as medium; repeated rows count
    each; no alerts give no rows.
    """
    if eps < LEAST_EPS:
        raise ValueError(f"eps {eps}; the grid needs {LEAST_EPS} or more")
    side = eps / 2 * (1 - 1e-9)
    placed = kept(_positions(alerts, group, side))
    points = placed.groupBy(F.col("_g").alias("g"), F.col("_cell").alias("cell"), F.col("_x").alias("x")).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    points = kept(points)
    cells = kept(points.groupBy("g", "cell").agg((F.sum("n") >= least).alias("full")))
    near = kept(_near(cells.select("g", "cell")))
    points = points.join(cells, ["g", "cell"])
    thin = points.filter("not full").select("g", "cell", "x").join(near, ["g", "cell"])
    others = points.select("g", F.col("cell").alias("to"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("ord").alias("o"), "full")
    touch = kept(thin.join(others, ["g", "to"]).filter(_square("x", "y") <= eps * eps + SLACK))
    lone = touch.groupBy("g", "x").agg(F.sum("m").alias("m")).filter(F.col("m") >= least).select("g", "x")
    core = kept(points.filter("full").unionByName(points.filter("not full").join(lone, ["g", "x"], "left_semi")).select("g", "cell", "x", "ord"))

    nodes = core.groupBy("g", "cell").agg(F.min("ord").cast("long").alias("ord")).withColumn("to", F.col("cell"))
    links = _links(core, near, eps, side).withColumn("ord", F.lit(None).cast("long"))
    pieces = kept(nodes.unionByName(links).groupBy("g").applyInPandas(_pieces, "g string, cell array<int>, cluster long, start long"))

    of = touch.join(lone.withColumnRenamed("x", "y").withColumn("sure", F.lit(True)), ["g", "y"], "left").filter("full or sure")
    of = of.join(pieces.withColumnRenamed("cell", "to"), ["g", "to"])
    own = of.groupBy("g", "x").agg(
        F.max(F.when(F.col("o") == F.col("start"), F.col("cluster"))).alias("started"),
        F.min("cluster").alias("joined"),
        F.max(F.when(F.col("x") == F.col("y"), F.col("cluster"))).alias("inside"),
    )
    own = own.select(F.col("g").alias("_g"), F.col("x").alias("_x"), F.coalesce("inside", "started", "joined").alias("_own"))
    full = cells.filter("full").join(pieces, ["g", "cell"]).select(F.col("g").alias("_g"), F.col("cell").alias("_cell"), F.col("cluster").alias("_all"))
    out = placed.join(full, ["_g", "_cell"], "left").join(own, ["_g", "_x"], "left")
    return out.select(*alerts.columns, F.coalesce("_all", "_own", F.lit(-1)).cast("long").alias("cluster"))


def cluster_summary(clustered: DataFrame, group: str) -> DataFrame:
    """Size, commonest service and type (ties: the first seen) and span of each cluster; noise is left out."""
    real = clustered.filter("cluster >= 0")
    keys = [group, "cluster"]
    out = real.groupBy(*keys).agg(F.count("*").alias("size"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    for c in ("service", "anomaly_type"):
        n = real.groupBy(*keys, c).agg(F.count("*").alias("n"), F.min("ord").alias("o"))
        out = out.join(n.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("n"), F.col("o"))).alias(f"top_{c}")), keys)
    return out


def incident_groups(summary: DataFrame, group: str) -> DataFrame:
    """The clusters of cluster_summary with `place` inside their batch: largest first, of equals the lower number."""
    return summary.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), "cluster"))).orderBy(group, "place")
