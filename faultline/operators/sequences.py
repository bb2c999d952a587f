"""A recurrent autoencoder over short sequences of metric snapshots.

It is trained on the driver from a bounded, seeded sample of healthy sequences, with its cells frozen: only the output layer
learns.  Spark gathers each sequence (the caller's key bounds its length) and scores many of one length at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import filled
from ..functions.scores import reconstruction_severity
from .models import FEATURES, HEALTHY
from .timeseries import SWING, trend_label

# fixed values: spread of a healthy feature from step to step, and what throughput adds to processor load and latency
STEP_SPREAD = (0.02, 0.005, 0.02, 0.02, 0.02, 0.02)
LOAD = {0: 0.1, 2: 0.08}
#: Features whose steps can make a sequence oscillate: processor load, error rate, latency.
SWINGING = (0, 1, 2)


def healthy_sequences(n: int = 500, length: int = 10, seed: int = 42) -> np.ndarray:
    """n x length x 6 values in [0, 1]; each step starts from the one before, so sequences drift upwards with load."""
    rng = np.random.RandomState(seed)
    start, noise = np.empty((n, len(HEALTHY))), np.empty((n, length, len(HEALTHY)))
    for k in range(n):
        start[k] = [rng.beta(a, b) for a, b in HEALTHY]
        noise[k] = rng.normal(0, STEP_SPREAD, (length, len(HEALTHY)))
    out, at = np.empty_like(noise), start
    for t in range(length):
        at = np.clip(at + noise[:, t], 0, 1)
        for feature, share in LOAD.items():
            at[:, feature] = np.clip(at[:, feature] + share * at[:, 3], 0, 1)
        out[:, t] = at
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Cell:
    """A long short-term memory cell without biases; the four gates are one matrix, and rows are sequences."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        limit = np.sqrt(6.0 / (inputs + 2 * hidden))
        gates = np.random.RandomState(seed).uniform(-limit, limit, (4, inputs + hidden, hidden))
        self.w = np.concatenate(gates, 1)

    def step(self, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        forget, take, show, new = np.split(np.concatenate([x, h], 1) @ self.w, 4, axis=1)
        c = _gate(forget) * c + _gate(take) * np.tanh(new)
        return _gate(show) * np.tanh(c), c


class SequenceCoder:
    """Encoder cell, decoder cell and output layer; the threshold is the 95th percentile of the training errors."""

    def __init__(self, x: np.ndarray, hidden: int = 8, epochs: int = 50, rate: float = 0.001, momentum: float = 0.9, drawn: int = 10, seed: int = 42):
        self.hidden = hidden
        self.encoder, self.decoder = Cell(x.shape[2], hidden, seed), Cell(hidden, hidden, seed + 1)
        self.w, self.b = np.random.RandomState(seed).randn(hidden, x.shape[2]) * 0.1, np.zeros(x.shape[2])
        states = self.states(x)  # frozen cells: the same in every epoch
        self.losses = [self._train(states, x, np.random.RandomState(seed + e), rate, momentum, drawn) for e in range(epochs)] if len(x) else []
        self.threshold = float(np.percentile(self.errors(x).mean(1), 95)) if len(x) else 0.0

    def _train(self, states: np.ndarray, x: np.ndarray, rng, rate: float, momentum: float, drawn: int) -> float:
        """One epoch; momentum starts at rest in the first and is carried on."""
        if not hasattr(self, "_speed"):
            self._speed = (np.zeros_like(self.w), np.zeros_like(self.b))
        loss, chosen = 0.0, rng.choice(len(x), min(drawn, len(x)), replace=False)
        for k in chosen:
            off = states[k] @ self.w + self.b - x[k]
            loss += float((off**2).mean())
            slope = 2 * off / off.size
            self._speed = (momentum * self._speed[0] - rate * states[k].T @ slope, momentum * self._speed[1] - rate * slope.sum(0))
            self.w, self.b = self.w + self._speed[0], self.b + self._speed[1]
        return loss / len(chosen)

    def states(self, x: np.ndarray) -> np.ndarray:
        """The decoder's states (n x length x hidden); it reads the encoder's last state at every step and starts from it."""
        n, length = x.shape[:2]
        h, c = np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        for t in range(length):
            h, c = self.encoder.step(x[:, t], h, c)
        code, c, out = h, np.zeros((n, self.hidden)), np.empty((n, length, self.hidden))
        for t in range(length):
            h, c = self.decoder.step(code, h, c)
            out[:, t] = h
        return out

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Mean squared error of each step (n x length)."""
        return ((self.states(x) @ self.w + self.b - x) ** 2).mean(2)


@functools.cache
def default_coder() -> SequenceCoder:
    """Trained once in a process; seeded, so every process gets the same."""
    return SequenceCoder(healthy_sequences())


def _slopes(x: np.ndarray) -> np.ndarray:
    """Least-squares slope of each feature against the step; 0 for a single step."""
    i = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    return np.einsum("t,ntf->nf", i, x) / (i @ i) if x.shape[1] > 1 else np.zeros((len(x), x.shape[2]))


def _scored(model: SequenceCoder, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(keys)
            lengths, flat = np.diff(steps.offsets.to_numpy()), steps.flatten()
            values = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            start = np.cumsum(lengths) - lengths
            n = batch.num_rows
            error, swings, slopes, far = np.zeros(n), np.zeros(n, bool), np.zeros((n, len(FEATURES))), [[] for _ in range(n)]
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                x = values[start[rows, None] + np.arange(length)]
                local = model.errors(x)
                error[rows], slopes[rows] = local.mean(1), _slopes(x)
                if length > 1:
                    swings[rows] = (np.abs(np.diff(x[:, :, SWINGING], axis=1)).std(1) > SWING).any(1)
                for row, hit in zip(rows, local > (local.mean(1) + local.std(1))[:, None], strict=True):
                    far[row] = np.flatnonzero(hit).tolist()
            columns = [*batch.columns[:keys], pa.array(lengths.astype(np.int64)), pa.array(error), pa.array(swings), pa.array(far, pa.list_(pa.int64())), *[pa.array(slopes[:, k].copy()) for k in range(len(FEATURES))]]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:keys], "n", "error", "_swings", "far_steps", *[f"{f}_slope" for f in FEATURES]])

    return run


def sequence_scores(df: DataFrame, keys: list[str], order: str, model: SequenceCoder | None = None) -> DataFrame:
    """keys, n, error (mean squared), is_anomaly, severity, far_steps (steps further off than the sequence's mean plus one
    standard deviation), ramp, trend, and the slope of each feature.

    `keys` name one sequence, such as a service and a stretch of time; they should bound its length, since a sequence is
    one row in memory.  Points come in order of `order`, ties in order of their values; a missing feature or value counts as
    0.  Null keys are a key of their own, and no points give no rows.  `keys` must not be called like a result column.
    """
    model = model or default_coder()
    kinds = dict(df.dtypes)
    points = filled(df, list(FEATURES)).select(*keys, F.struct(F.col(order).alias("at"), *FEATURES).alias("step"))
    whole = points.groupBy(*keys).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    numbers = ", ".join(f"{f}_slope double" for f in FEATURES)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, error double, _swings boolean, far_steps array<long>", numbers])
    out = whole.mapInArrow(_scored(model, len(keys)), schema)
    ramp, _, trend = trend_label(F.col("n"), F.col("latency_p99_slope"), F.col("throughput_slope"), F.col("_swings"))
    bar = F.lit(model.threshold)
    return out.select(*keys, "n", "error", (F.col("error") > bar).alias("is_anomaly"), reconstruction_severity(F.col("error"), bar).alias("severity"), "far_steps", ramp.alias("ramp"), trend.alias("trend"), *[f"{f}_slope" for f in FEATURES])
