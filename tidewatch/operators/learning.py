"""Small models in numpy inside grouped tasks: per-key training on bounded stores, gradient projection, and federated rounds.

A key's store is bounded (latest samples), so a group fits a task; averaging of parameters is a Spark aggregate over owners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import weighted_vectors


class Perceptron:
    """Layers of rectified units and a sigmoid output; parameters in one flat vector; AMSGrad updates with weight decay."""

    def __init__(self, inputs: int, hidden: tuple[int, ...] = (32, 32), seed: int = 0, rate: float = 0.01, decay: float = 1e-3):
        self.sizes = (inputs, *hidden, 1)
        self.rate, self.decay = rate, decay
        rng = np.random.default_rng(seed)
        self.parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = 1 / np.sqrt(a)
            self.parts += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        self.moments = [[np.zeros_like(p) for p in self.parts] for _ in range(3)]
        self.steps = 0

    @property
    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @vector.setter
    def vector(self, flat) -> None:
        at, flat = 0, np.asarray(flat, dtype=float)
        for i, p in enumerate(self.parts):
            self.parts[i] = flat[at : at + p.size].reshape(p.shape).copy()
            at += p.size

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        layers = [x]
        for i in range(0, len(self.parts), 2):
            z = layers[-1] @ self.parts[i] + self.parts[i + 1]
            layers.append(np.maximum(z, 0) if i + 2 < len(self.parts) else 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return layers[-1][:, 0], layers

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, layers = self.scores(x)
        back, out = ((p - y) / len(y))[:, None], []
        for i in range(len(self.parts) - 2, -1, -2):
            out = [layers[i // 2].T @ back, back.sum(axis=0), *out]
            back = (back @ self.parts[i].T) * (layers[i // 2] > 0)
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        self.steps += 1
        m, v, top = self.moments
        for i, g in enumerate(self.gradients(x, y)):
            g = g + self.decay * self.parts[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            top[i] = np.maximum(top[i], v[i])
            scale = self.rate / (1 - 0.9**self.steps)
            self.parts[i] = self.parts[i] - scale * m[i] / (np.sqrt(top[i] / (1 - 0.999**self.steps)) + 1e-8)


def train(store: DataFrame, key: list[str], inputs: int, start: list[float] | None = None, epochs: int = 10, least: int = 32, batch: int = 32, patience: int | None = None) -> DataFrame:
    """One model for each key from its bounded store (``order``, ``x``, ``y``): ``key``, ``n``, ``loss``, ``parameters``. Keys with fewer than
    ``least`` samples keep the start. With ``patience``, a fifth is held out and the best epoch's parameters are kept."""
    schema = store.select(*key, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("loss"), F.lit(None).cast("array<double>").alias("parameters")).schema

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
        net = Perceptron(inputs)
        if start is not None:
            net.vector = start
        rng = np.random.default_rng(1)
        held = np.zeros(len(y), bool)
        if patience is not None and len(y) >= 5:
            held[rng.permutation(len(y))[: len(y) // 5]] = True
        best, left = (np.inf, net.vector), patience
        loss = lambda a, b: float(np.abs(net.scores(a)[0] - b).mean())
        for _ in range(epochs if len(y) >= least else 0):
            order = rng.permutation(np.flatnonzero(~held))
            for at in range(0, len(order), batch):
                net.step(x[order[at : at + batch]], y[order[at : at + batch]])
            if held.any():
                now = loss(x[held], y[held])
                if now < best[0] - 1e-4:
                    best, left = (now, net.vector), patience
                else:
                    left -= 1
                    if left <= 0:
                        break
        if held.any() and np.isfinite(best[0]):
            net.vector = best[1]
        row = {k: pdf[k].iloc[0] for k in key} | {"n": len(y), "loss": loss(x, y), "parameters": net.vector.tolist()}
        return pd.DataFrame([row])[[*key, "n", "loss", "parameters"]]

    return store.groupBy(*key).applyInPandas(fit, schema)


def federated(store: DataFrame, client: str, inputs: int, rounds: int = 3, epochs: int = 2) -> list[float]:
    """Rounds of local training and weighted averaging over clients; the averaged parameters, whose number the network fixes."""
    now = Perceptron(inputs).vector.tolist()
    for _ in range(rounds):
        local = train(store, [client], inputs, now, epochs).select(F.lit(0).alias("model"), F.col(client).alias("owner"), "n", "parameters")
        now = [r.value for r in weighted_vectors(local, ["model"], "parameters", "n").orderBy("at").collect()]
    return now


def evaluate(rows: DataFrame, parameters: list[float], inputs: int) -> DataFrame:
    """``rows`` with ``score`` and ``loss`` of one model."""
    names = [*rows.columns, "score", "loss"]
    shared = rows.sparkSession.sparkContext.broadcast(parameters)

    def run(batches):
        net = Perceptron(inputs)
        net.vector = shared.value
        for pdf in batches:
            score = net.scores(np.stack(pdf["x"].to_numpy()).astype(float))[0] if len(pdf) else np.zeros(0)
            yield pdf.assign(score=score, loss=np.abs(score - pdf["y"].to_numpy(float)))[names]

    return rows.mapInPandas(run, rows.select("*", F.lit(0.0).alias("score"), F.lit(0.0).alias("loss")).schema)


def _plus(a: Column, b: Column, factor: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def project_conflicts(groups: DataFrame, vectors: str = "vectors") -> DataFrame:
    """``groups`` with ``projected``: each vector of the array, in order, without its component against every other one (in order) that it
    conflicts with. Vectors are arrays of doubles; the array is one update's, a handful."""

    def cleaned(v: Column, i: Column) -> Column:
        start = F.struct(v.alias("v"), F.lit(0).alias("j"))

        def against(state: Column, other: Column) -> Column:
            inner, square = _dot(state["v"], other), _dot(other, other)
            clash = (state["j"] != i) & (square > 0) & (inner < 0)
            return F.struct(F.when(clash, _plus(state["v"], other, -inner / square)).otherwise(state["v"]).alias("v"), (state["j"] + 1).alias("j"))

        return F.aggregate(F.col(vectors), start, against, lambda s: s["v"])

    return groups.withColumn("projected", F.transform(vectors, cleaned))


def update_change(reference: Column, applied: Column) -> Column:
    """How an applied update differs from a reference one: cosine, ratio of norms, relative distance; null where the reference is zero."""
    size = lambda a: F.sqrt(_dot(a, a))
    cosine = F.when(size(applied) > 0, _dot(reference, applied) / (size(reference) * size(applied))).otherwise(0.0)
    gap = F.zip_with(applied, reference, lambda x, y: x - y)
    return F.when(size(reference) > 0, F.struct(cosine.alias("cosine"), (size(applied) / size(reference)).alias("norm_ratio"), (size(gap) / size(reference)).alias("delta_ratio")))


def adapter(feature: np.ndarray, down: np.ndarray, up: np.ndarray) -> np.ndarray:
    """A low-rank residual: feature + up(relu(down(feature))); the identity while ``up`` is zero."""
    return feature + np.maximum(feature @ down, 0) @ up
