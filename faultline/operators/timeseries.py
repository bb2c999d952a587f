"""Sequential operators on metric series: change points, trends, streaks, rate limits and ledgers.

Folds read one key's rows in time order and carry a small state from row to row, so a key's history is never gathered and
a step costs the same however long it is.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import sigma_severity

TINY = 1e-10
#: Slope from which a series climbs or falls, and spread of its steps from which it swings.
STEEP, SWING = 0.02, 0.15


def baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mu and sigma (of the population, at least 1e-10) of each key."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mu"), F.greatest(F.stddev_pop(value), F.lit(TINY)).alias("sigma"))


def _in_order(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's rows together and in order, in partitions that hold whole keys."""
    return df.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order)


def cusum(df: DataFrame, keys: list[str], order: str, value: str, base: DataFrame, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided CUSUM alarms of each key: index, order column, value, direction, magnitude (in sigmas) and severity.

    An alarm sets back the sum of its own side only, and an upward alarm at a point hides a downward one.  The two sums are
    carried from point to point, so a key's points are never gathered.
    """
    kinds = dict(df.dtypes)
    points = df.select(*keys, F.col(order), F.col(value).cast("double").alias("_v")).join(base.select(*keys, "mu", "sigma"), keys)

    def run(batches):
        now, up, down, i = None, 0.0, 0.0, 0
        for batch in batches:
            rows, alarms = zip(*[c.to_pylist() for c in batch.columns], strict=True) if batch.num_rows else [], []
            for at, row in enumerate(rows):
                *key, _, v, mu, sigma = row
                if key != now:
                    now, up, down, i = key, 0.0, 0.0, 0
                if v is not None and mu is not None:
                    up, down = max(0.0, up + (v - mu - k * sigma)), min(0.0, down + (v - mu + k * sigma))
                    if up > h * sigma:
                        alarms.append((at, i, "up", abs(v - mu) / sigma))
                        up = 0.0
                    elif abs(down) > h * sigma:
                        alarms.append((at, i, "down", abs(v - mu) / sigma))
                        down = 0.0
                i += 1
            if alarms:
                at, idx, direction, magnitude = zip(*alarms, strict=True)
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keys)], pa.array(idx, pa.int64()), *kept.columns[len(keys) : len(keys) + 2], pa.array(direction), pa.array(magnitude)], [*keys, "idx", order, value, "direction", "magnitude"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "idx long", f"{order} {kinds[order]}", f"{value} double", "direction string", "magnitude double"])
    return _in_order(points, keys, [order]).mapInArrow(run, schema).withColumn("severity", sigma_severity(F.col("magnitude")))


def first_change(alarms: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest alarm of each key."""
    rest = [c for c in alarms.columns if c not in (*keys, "idx")]
    return alarms.groupBy(*keys).agg(F.min_by(F.struct("idx", *rest), "idx").alias("c")).select(*keys, "c.*")


def slope(value: str, index: str) -> Column:
    """Least-squares slope against the index."""
    return F.regr_slope(F.col(value), F.col(index))


def trend_label(n: Column, latency_slope: Column, throughput_slope: Column, swings: Column) -> tuple[Column, Column, Column]:
    """Ramp (latency climbs while throughput falls), oscillation and the label, each only from three points on."""
    ramp = F.coalesce((n >= 3) & (latency_slope > STEEP) & (throughput_slope < -STEEP), F.lit(False))
    oscillating = (n >= 3) & swings
    return ramp, oscillating, F.when(ramp, "degrading").when(oscillating, "oscillating").otherwise("stable")


def trend_rules(df: DataFrame, keys: list[str], order: str, latency: str, throughput: str, others: list[str] = ()) -> DataFrame:
    """Slopes, whether latency rises while throughput falls (ramp), whether a series swings (oscillation), and the label."""
    w = Window.partitionBy(*keys).orderBy(order)
    swinging = [latency, *others]
    df = df.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    for c in swinging:
        df = df.withColumn(f"_d_{c}", F.abs(F.col(c) - F.lag(c).over(w)))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), slope(latency, "_i").alias("latency_slope"), slope(throughput, "_i").alias("throughput_slope"), *[F.stddev_pop(f"_d_{c}").alias(f"_s_{c}") for c in swinging]
    )
    swings = F.lit(False)
    for c in swinging:
        swings = swings | F.coalesce(F.col(f"_s_{c}") > SWING, F.lit(False))
    ramp, oscillating, trend = trend_label(F.col("n"), F.col("latency_slope"), F.col("throughput_slope"), swings)
    out = out.withColumn("ramp", ramp).withColumn("oscillating", oscillating)
    return out.withColumn("trend", trend).drop(*[f"_s_{c}" for c in swinging])


def incident_start(df: DataFrame, keys: list[str], order: str, flag: str, window: int) -> DataFrame:
    """The first point of the first run of `window` flagged points in a row; keys without one are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1).filter(flag)
    runs = numbered.withColumn("_g", F.col("_i") - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.count("*").alias("run"), F.min("_i").alias("start_idx"), F.min(order).alias("start"))
    return runs.filter(F.col("run") >= window).groupBy(*keys).agg(F.min_by(F.struct("start_idx", "start", "run"), "start_idx").alias("c")).select(*keys, F.col("c.start_idx").cast("long").alias("start_idx"), "c.start", F.col("c.run").alias("run_length"))


def streaks(df: DataFrame, keys: list[str], order: str, flag: str, window: int = 3) -> DataFrame:
    """Adds `streak`, the flagged points in a row up to each one (0 where the flag is false or null), `first`, the order of the
    first of them, and `starts`, true where there are `window` of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.coalesce(F.col(flag), F.lit(False))
    cut = df.withColumn("_on", on).withColumn("_g", F.count_if(~on).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_g", "_on").orderBy(order)
    out = cut.withColumn("streak", F.when(F.col("_on"), F.row_number().over(own)).otherwise(0).cast("long"))
    first = F.when(F.col("_on"), F.min(order).over(own))
    return out.withColumn("first", first).withColumn("starts", F.col("streak") == window).drop("_on", "_g")


def outliers_in_window(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows above their key's mean plus one population standard deviation."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_bar", F.avg(value).over(w) + F.stddev_pop(value).over(w)).filter(F.col(value) > F.col("_bar")).drop("_bar")


def rate_limit(hits: DataFrame, key: str, at: str, most: int = 30, seconds: int = 60) -> DataFrame:
    """Each hit (time in seconds) with `allowed`: fewer than `most` allowed hits in the seconds before.  Refused hits do not count.

    The state of a key is its last `most` allowed times, so a step costs the same however long the key's history is.
    """
    kinds = dict(hits.dtypes)

    def run(batches):
        now, started, held = None, False, deque()
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or k != now:
                    now, started, held = k, True, deque()
                while held and t - held[0] >= seconds:
                    held.popleft()
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(t)
            yield pa.record_batch([*batch.columns, pa.array(allowed, pa.bool_())], [key, at, "allowed"])

    return _in_order(hits.select(key, at).filter(F.col(at).isNotNull()), [key], [at]).mapInArrow(run, f"{key} {kinds[key]}, {at} {kinds[at]}, allowed boolean")


def _moved(stock: int | None, kind: str | None, quantity: int | None) -> tuple[bool | None, int | None]:
    """Whether a move is accepted, and the stock after it; nulls count as in SQL."""
    enough = None if stock is None or quantity is None else stock >= quantity
    if kind is not None and kind != "reserve":
        return True, None if enough is None else stock + quantity
    ok = enough if kind is not None or enough else None
    return ok, stock - quantity if ok else stock


def stock_ledger(moves: DataFrame, key: str, order: str, kind: str, quantity: str, opening: int = 0) -> DataFrame:
    """Each move in order with `accepted` and the stock after it: a reservation needs enough stock, a release always adds.

    Moves are read in order and each key's stock is carried from one to the next, so a step costs the same and holds the
    same however many moves a key has.
    """
    kinds = dict(moves.dtypes)
    rows = moves.select(F.col(key), F.col(order), F.col(kind).alias("_k"), F.col(quantity).cast("long").alias("_q"))

    def run(batches):
        now, stock, started = None, opening, False
        for batch in batches:
            accepted, left = [], []
            for k, move, q in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not started or k != now:
                    now, stock, started = k, opening, True
                ok, stock = _moved(stock, move, q)
                accepted.append(ok)
                left.append(stock)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(accepted, pa.bool_()), pa.array(left, pa.int64())], [key, order, "accepted", "stock"])

    return _in_order(rows, [key], [order, "_k", "_q"]).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, stock long")
