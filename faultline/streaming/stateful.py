"""Structured Streaming counterparts of the sequential operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cusum_stream(points: DataFrame, key: str, mu: float, sigma: float, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Alarms of a stream of (key, ts, value); the two sums and the index are the state of a key."""

    def run(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, i = state.get if state.exists else (0.0, 0.0, 0)
        rows = []
        for ts, v in pd.concat(list(frames)).sort_values("ts")[["ts", "value"]].itertuples(index=False):
            up, down = max(0.0, up + v - mu - k * sigma), min(0.0, down + v - mu + k * sigma)
            if up > h * sigma:
                rows.append((*name, i, ts, v, "up", abs(v - mu) / sigma))
                up = 0.0
            elif -down > h * sigma:
                rows.append((*name, i, ts, v, "down", abs(v - mu) / sigma))
                down = 0.0
            i += 1
        state.update((up, down, i))
        yield pd.DataFrame(rows, columns=[key, "idx", "ts", "value", "direction", "magnitude"])

    schema = f"{key} {dict(points.dtypes)[key]}, idx long, ts timestamp, value double, direction string, magnitude double"
    return points.select(key, "ts", "value").groupBy(key).applyInPandasWithState(run, schema, "up double, down double, i long", "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(hits: DataFrame, key: str, most: int = 30, seconds: int = 60) -> DataFrame:
    """Each hit of a stream of (key, t) with `allowed`; the state of a key is its allowed times of the last seconds."""

    def run(name, frames, state):
        held = list(state.get[0]) if state.exists else []
        rows = []
        for t in pd.concat(list(frames))["t"].sort_values():
            held = [x for x in held if t - x < seconds]
            ok = len(held) < most
            if ok:
                held.append(int(t))
            rows.append((*name, int(t), ok))
        state.update((held,))
        yield pd.DataFrame(rows, columns=[key, "t", "allowed"])

    return hits.select(key, "t").groupBy(key).applyInPandasWithState(run, f"{key} {dict(hits.dtypes)[key]}, t long, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def stock_stream(moves: DataFrame, key: str) -> DataFrame:
    """Each move of a stream of (key, o, kind, quantity) with `accepted` and the stock after it."""

    def run(name, frames, state):
        stock = state.get[0] if state.exists else 0
        rows = []
        for o, kind, q in pd.concat(list(frames)).sort_values(["o", "kind", "quantity"])[["o", "kind", "quantity"]].itertuples(index=False):
            ok = kind != "reserve" or stock >= q
            stock += -q if kind == "reserve" and ok else q if kind != "reserve" else 0
            rows.append((*name, o, ok, stock))
        state.update((int(stock),))
        yield pd.DataFrame(rows, columns=[key, "o", "accepted", "stock"])

    return moves.groupBy(key).applyInPandasWithState(run, f"{key} {dict(moves.dtypes)[key]}, o long, accepted boolean, stock long", "stock long", "append", GroupStateTimeout.NoTimeout)


def once(requests: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key's first request within the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, keys: list[str], at: str = "ts", width: str = "30 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by time window; `at` is cast, as watermarks need a timestamp with a zone."""
    w = F.window(F.col(at), width, slide) if slide else F.window(F.col(at), width)
    out = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
