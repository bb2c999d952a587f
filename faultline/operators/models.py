"""Anomaly models: isolation forest, autoencoder and their ensemble, trained on the driver from a bounded, seeded sample of
healthy snapshots and applied to any number of rows in Arrow batches."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ensemble_severity, forest_severity, path_norm
from .timeseries import incident_start

FEATURES = ("cpu_pct", "error_rate", "latency_p99", "throughput", "mem_pct", "db_query_ms")
# fixed values: what 0 and 1 stand for in each feature
RANGES = ((0, 100), (0, 1), (0, 5000), (0, 2000), (0, 100), (0, 3000))
# fixed values: Beta parameters of healthy features
HEALTHY = ((2, 5), (1, 30), (2, 6), (5, 2), (3, 4), (2, 7))


def healthy_snapshots(n: int = 3000, seed: int = 42) -> np.ndarray:
    rng = np.random.RandomState(seed)
    x = np.stack([rng.beta(a, b, n) for a, b in HEALTHY], 1)
    x[:, 0] += 0.15 * x[:, 3]
    x[:, 2] += 0.10 * x[:, 3]
    return np.clip(x + rng.normal(0, 0.01, x.shape), 0, 1)


class IsolationForest:
    """Trees in flat arrays; a leaf has feature -1 and holds its depth plus the mean path below it."""

    def __init__(self, x: np.ndarray, trees: int = 100, most: int = 256, contamination: float = 0.1, seed: int = 42):
        rng = np.random.RandomState(seed)
        self.sample = min(len(x), most)
        self.deepest = math.ceil(math.log2(max(2, self.sample)))
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._grow(x[rng.randint(0, len(x), self.sample)], 0, rng))
        self.feature, self.cut, self.left, self.right, self.value = (np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.value))
        ordered = np.sort(self.score(x))
        self.threshold = float(ordered[min(int((1 - contamination) * len(x)), len(x) - 1)])

    def _grow(self, x: np.ndarray, depth: int, rng) -> int:
        k = len(self.feature)
        for v, start in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, depth + path_norm(len(x)))):
            v.append(start)
        if depth >= self.deepest or len(x) <= 1:
            return k
        for _ in range(x.shape[1]):
            j = rng.randint(x.shape[1])
            low, high = x[:, j].min(), x[:, j].max()
            if low < high:
                self.feature[k], self.cut[k] = j, rng.uniform(low, high)
                goes = x[:, j] < self.cut[k]
                self.left[k] = self._grow(x[goes], depth + 1, rng)
                self.right[k] = self._grow(x[~goes], depth + 1, rng)
                break
        return k

    def nodes(self) -> list[tuple]:
        """The trees as rows (tree, node, feature, cut, left, right, value); the nodes of a tree follow its root, and a leaf has
        feature -1."""
        tree = np.searchsorted(np.array(self.roots), np.arange(len(self.feature)), "right") - 1
        columns = (tree, np.arange(len(self.feature)), self.feature, self.cut, self.left, self.right, self.value)
        return list(zip(*(np.asarray(c).tolist() for c in columns), strict=True))

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path of each row over the trees."""
        total = np.zeros(len(x))
        feature, cut, left, right, value = (np.asarray(v) for v in (self.feature, self.cut, self.left, self.right, self.value))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] < cut[node], left[node], right[node])
            total += value[at]
        return total / len(self.roots)

    def scored(self, paths: np.ndarray) -> np.ndarray:
        return 2.0 ** (-paths / max(path_norm(self.sample), 1e-10))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scored(self.paths(x))


class Autoencoder:
    """6-8-4-2-4-8-6, rectified, with a sigmoid at the end; minibatch descent on the squared error."""

    SIZES = (6, 8, 4, 2, 4, 8, 6)

    def __init__(self, x: np.ndarray, epochs: int = 250, rate: float = 0.003, batch: int = 128, seed: int = 7):
        rng, order = np.random.RandomState(seed), np.random.RandomState(0)
        self.w = [rng.randn(a, b) * math.sqrt(2.0 / a) for a, b in zip(self.SIZES[:-1], self.SIZES[1:], strict=True)]
        self.b = [np.zeros(b) for b in self.SIZES[1:]]
        for _ in range(epochs):
            at = order.permutation(len(x))
            for k in range(0, len(x), batch):
                self._step(x[at[k : k + batch]], rate)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = layers[-1] @ w + b
            layers.append(np.maximum(z, 0) if k < len(self.w) - 1 else 1 / (1 + np.exp(-np.clip(z, -20, 20))))
        return layers

    def _step(self, x: np.ndarray, rate: float) -> None:
        layers = self._forward(x)
        d = 2 * (layers[-1] - x) / len(x) * layers[-1] * (1 - layers[-1])
        for k in range(len(self.w) - 1, -1, -1):
            gw, gb = layers[k].T @ d, d.sum(0)
            d = (d @ self.w[k].T) * (layers[k] > 0) if k else d
            self.w[k] -= rate * gw
            self.b[k] -= rate * gb

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Squared error of each row and feature."""
        return (self.rebuilt(x) - x) ** 2

    def rebuilt(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1]


class Ensemble:
    def __init__(self, x: np.ndarray, epochs: int = 250):
        self.coder, self.forest = Autoencoder(x, epochs), IsolationForest(x, contamination=0.01)
        self.coder_threshold = float(np.percentile(self.coder.errors(x).mean(1), 99))
        self.threshold = float(np.percentile(self.score(x)[0], 99))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        errors = self.coder.errors(x)
        mse = errors.mean(1)
        tree = self.forest.score(x)
        return 0.55 * np.clip(mse / (3 * self.coder_threshold), 0, 1) + 0.45 * tree, mse, tree, errors


@functools.cache
def default_ensemble() -> Ensemble:
    """Trained once in a process; seeded, so every process gets the same."""
    return Ensemble(healthy_snapshots())


@functools.cache
def default_forest() -> IsolationForest:
    """The forest of the default ensemble, without the rest of it."""
    return IsolationForest(healthy_snapshots(), contamination=0.01)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[list(FEATURES)].fillna(0.0).to_numpy(float)


def forest_scores(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """Adds score, is_anomaly and severity; a missing feature counts as 0."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", score double"
    out = df.mapInPandas(lambda it: (p.assign(score=forest.score(_matrix(p))) for p in it), schema)
    flag = F.col("score") > F.lit(forest.threshold)
    return out.withColumn("is_anomaly", flag).withColumn("severity", forest_severity(F.col("score"), flag))


def calibrated_threshold(healthy: DataFrame, model: Ensemble) -> float:
    """The 99th percentile of the scores of healthy snapshots; the model's own threshold if there are none."""
    found = ensemble_scores(healthy, model).agg(F.expr("percentile(score, 0.99)")).first()[0]
    return model.threshold if found is None else found


def ensemble_scores(df: DataFrame, model: Ensemble) -> DataFrame:
    """Adds the ensemble's whole result: score, is_anomaly, severity and confidence; of the coder the error, its threshold,
    whether it is exceeded, each feature's error and what the features were taken for; of the forest score, mean path and
    flag; and anomalous_features, the three that are furthest off, with what was seen and what would have been normal, in
    natural units.  Features are taken as lying in [0, 1]; they are not rescaled, and a missing one counts as 0."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", score double, confidence double, error double, _e array<double>, _x array<double>, _r array<double>, forest_score double, forest_path double"

    def run(it):
        low, high = np.array(RANGES, float).T
        for p in it:
            x = _matrix(p)
            score, mse, tree, errors = model.score(x)
            yield p.assign(
                score=score, confidence=np.minimum(1, score / max(model.threshold, 1e-9)), error=mse, _e=list(errors), _x=list(low + x * (high - low)), _r=list(low + model.coder.rebuilt(x) * (high - low)),
                forest_score=tree, forest_path=model.forest.paths(x),
            )

    out = df.mapInPandas(run, schema)
    flag = F.col("score") > F.lit(model.threshold)
    named = [F.struct(F.lit(f).alias("feature"), F.get("_e", F.lit(k)).alias("error"), F.get("_x", F.lit(k)).alias("observed"), F.get("_r", F.lit(k)).alias("reconstructed_as_normal")) for k, f in enumerate(FEATURES)]
    # largest error first; of equal ones the later feature, as a reversed ascending sort has it
    order = F.reverse(F.array_sort(F.array(*[F.struct(F.get("_e", F.lit(k)).alias("e"), F.lit(k).alias("k")) for k in range(len(FEATURES))])))
    return out.withColumns({
        "is_anomaly": flag, "severity": ensemble_severity(F.col("score"), flag), "error_threshold": F.lit(model.coder_threshold), "error_is_anomaly": F.col("error") > F.lit(model.coder_threshold),
        "forest_is_anomaly": F.col("forest_score") > F.lit(model.forest.threshold), "feature_errors": F.transform(F.array(*named), lambda n: F.struct(n["feature"].alias("feature"), n["error"].alias("error"))),
        "reconstructed": F.col("_r"), "anomalous_features": F.transform(F.slice(order, 1, 3), lambda o: F.get(F.array(*named), o["k"])),
    }).drop("_e", "_x", "_r")


def incident_starts(scored: DataFrame, keys: list[str], order: str, window: int = 3) -> DataFrame:
    """The first of the first `window` anomalous snapshots in a row of each key."""
    return incident_start(scored, keys, order, "is_anomaly", window)
