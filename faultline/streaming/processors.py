"""Keyed stream processors with state of their own: a counter of anomalies in a row, a limiter that forgets idle keys, and a
bounded buffer.  They run by transformWithState, whose state lies in RocksDB on the executors' disks and is backed by the
query's checkpoint, so a restarted query goes on where it was.

Rows of a key are taken in order within a micro-batch, and batches in order of arrival.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def with_rocks(spark: SparkSession) -> SparkSession:
    """Set the state store that these processors need."""
    spark.conf.set(STORE, ROCKS)
    return spark


#: Groups that keys are dealt to by their hash.  Every group of every batch is a call with its own frames and reads of state,
#: which cost a thousand times what a row does.
GROUPS = 1024


class Streaks(StatefulProcessor):
    """How many anomalies came in a row for each key of a group, and where the row began; a healthy point sets it back.  The
    state lists the keys whose last point was an anomaly."""

    def __init__(self, window: int, kind: str):
        self.window, self.kind = window, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("streaks", f"key {self.kind}, n long, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k: (n, first) for k, n, first in self.state.get()} if self.state.exists() else {}
        had = bool(held)
        every = pd.concat(list(rows), ignore_index=True)
        # a group has either no null key or nothing else
        codes, names = (np.zeros(len(every), "int64"), [None]) if every["key"].isna().all() else pd.factorize(every["key"])
        names = names if isinstance(names, list) else names.tolist()
        order = np.lexsort((every["o"].to_numpy(), codes))
        codes, o, flag = codes[order], every["o"].to_numpy()[order], every["flag"].to_numpy(bool)[order]
        at = np.arange(len(o))
        begins = np.r_[True, codes[1:] != codes[:-1]]
        start = np.maximum.accumulate(np.where(begins, at, 0))
        healthy = np.maximum.accumulate(np.where(flag, -1, at))  # the last healthy point so far, of whatever key
        before = np.maximum(healthy, start - 1)
        olds = [held.get(name, (0, None)) for name in names]
        old_n, old_first = np.array([n for n, _ in olds], "int64")[codes], np.array([first or 0 for _, first in olds], "int64")[codes]
        goes_on = flag & (before == start - 1) & (old_n > 0)
        streak = at - before + np.where(goes_on, old_n, 0)
        first = np.where(goes_on, old_first, o[np.minimum(before + 1, len(o) - 1)])
        for k in np.flatnonzero(np.r_[begins[1:], True]).tolist():
            name = names[codes[k]]
            held.pop(name, None)
            if flag[k]:
                held[name] = (int(streak[k]), int(first[k]))
        if held:
            self.state.put([(name, *value) for name, value in held.items()])
        elif had:
            self.state.clear()
        yield pd.DataFrame({"key": every["key"].to_numpy()[order], "o": o, "streak": streak, "first": pd.arrays.IntegerArray(first, ~flag), "starts": streak == self.window}, copy=False)

    def close(self) -> None:
        pass


def anomaly_streaks(points: DataFrame, key: str, order: str, flag: str, window: int = 3) -> DataFrame:
    """Each point of a stream with `streak`, the anomalies in a row up to it (0 for a healthy one), `first`, where they began,
    and `starts`, true on the point that makes `window` of them: an incident, which began at `first`.  A null flag is healthy."""
    rows = points.select(F.col(key).alias("key"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, o long, streak long, first long, starts boolean"
    group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.hash("key"), F.lit(GROUPS)))
    out = rows.withColumn("group", group).groupBy("group").transformWithStateInPandas(Streaks(window, kind), schema, "append", "none")
    return out.select(F.col("key").alias(key), F.col("o").alias(order), "streak", "first", "starts")


class Limiter(StatefulProcessor):
    """The allowed times of a key within the last seconds.  A timer at the end of the last one's window clears the key."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.held.get()] if self.held.exists() else []
        timer = held[-1] if held else None
        out = []
        for t in sorted(int(t) for frame in rows for t in frame["t"]):
            held = [x for x in held if t - x < self.seconds]
            out.append((*key, t, len(held) < self.most))
            if out[-1][2]:
                held.append(t)
        if held:
            self.held.put([(t,) for t in held])
        else:
            self.held.clear()
        if timer is not None and (not held or held[-1] != timer):
            self.handle.deleteTimer(1000 * (timer + self.seconds))
        if held:
            self.handle.registerTimer(1000 * (held[-1] + self.seconds))
        yield pd.DataFrame(out, columns=["key", "t", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=object), "t": pd.Series(dtype="int64"), "allowed": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def limited(hits: DataFrame, key: str, at: str, most: int = 30, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """Each hit of a stream with its whole second `t` and `allowed`: fewer than `most` allowed hits in the `seconds` before.
    A key that is idle for so long leaves the state when the watermark passes; hits later than the watermark are dropped."""
    ts = F.col(at).cast("timestamp")
    rows = hits.select(F.col(key).alias("key"), ts.alias("ts"), F.unix_seconds(ts).alias("t")).withWatermark("ts", late)
    schema = f"key {dict(rows.dtypes)['key']}, t long, allowed boolean"
    out = rows.groupBy("key").transformWithStateInPandas(Limiter(most, seconds), schema, "append", "eventTime")
    return out.select(F.col("key").alias(key), "t", "allowed")


class Ring(StatefulProcessor):
    """The newest `most` items of a key in as many slots, each overwritten by the item that pushes its own out."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.ring = handle.getMapState("ring", "slot long", "o long, item string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        n, newest = before, []  # a heap of no more than `most`
        for frame in rows:
            for o, item in zip(frame["o"].tolist(), frame["item"].tolist(), strict=True):
                n += 1
                entry = (o, n, item)
                heapq.heappush(newest, entry) if len(newest) < self.most else heapq.heappushpop(newest, entry)
        for at, (o, _, item) in enumerate(sorted(newest), n - len(newest)):
            self.ring.updateValue((at % self.most,), (o, item))
        self.count.update((n,))
        yield pd.DataFrame([(*key, n - before, min(n, self.most))], columns=["key", "added", "held"])

    def close(self) -> None:
        pass


def buffered(items: DataFrame, key: str, order: str, item: str, most: int = 10_000) -> DataFrame:
    """A stream of (key, added, held): how many items a batch added to a key's buffer, and how many it holds, the newest
    `most`.  The buffer is the query's state; `buffer_of` reads it."""
    rows = items.select(F.col(key).alias("key"), F.col(order).cast("long").alias("o"), F.col(item).cast("string").alias("item"))
    schema = f"key {dict(rows.dtypes)['key']}, added long, held long"
    out = rows.groupBy("key").transformWithStateInPandas(Ring(most), schema, "append", "none")
    return out.select(F.col("key").alias(key), "added", "held")


def buffer_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, o, item of what the buffers of a query hold, from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return state.select(F.col("key.key").alias("key"), F.col("user_map_value.o").alias("o"), F.col("user_map_value.item").alias("item"))


def held_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys that a limiter's state still has."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select(F.col("key.key").alias("key")).distinct()
