"""A learned metric: a weight per column plus a low-rank turn, fitted so that rows of one class lie near and others far.

Pairs of rows come from hash order, a few partners per row, so their number grows with the table and not with its square.
The loss of a pair is logistic in its squared distance less a bound; its gradient has a closed form, which tasks sum up
over their pairs: an iteration is one job whose result is a row of numbers per model, and the driver takes Adam's step.
All models (one per fold and one of all rows) are fitted in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import estimators as E
from .graph import cut_lineage
from .pairwise import hashed_partners

#: Adam's decay rates and the least denominator.
DECAY, DECAY2, TINY = 0.9, 0.999, 1e-8


def unpacked(theta: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the columns, the turn (k x p), the bound."""
    return theta[:p], theta[p:-1].reshape(-1, p), theta[-1]


def loss_and_gradient(theta: np.ndarray, delta: np.ndarray, same: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Summed over pairs with differences delta: log(1 + exp(t (d - bound))), t = 1 for pairs of one class and -1 for others; ridge a pair."""
    p = delta.shape[1]
    s, turn, bound = unpacked(theta, p)
    z = delta @ turn.T
    d = (delta**2) @ (s**2) + (z**2).sum(1)
    t = np.where(same, 1.0, -1.0)
    u = t * (d - bound)
    pull = t / (1 + np.exp(-np.clip(u, -500, 500)))
    gradient = np.concatenate([2 * s * (pull @ delta**2), (2 * (z * pull[:, None]).T @ delta).ravel(), [-pull.sum()]])
    n = len(delta)
    return float(np.logaddexp(0, u).sum() + n * ridge * (theta[:-1] ** 2).sum()), gradient + n * ridge * 2 * np.append(theta[:-1], 0)


@dataclass(frozen=True)
class Metric(E.Estimator):
    """The row in the learned space: its weighted columns and its turned coordinates; plain distances there are the learned ones."""

    rank: int = 4
    rounds: int = 30
    rate: float = 0.05
    partners: int = 4
    ridge: float = 1e-4
    seed: int = 5
    name: str = "metric"

    def pairs(self, rows, x: str):
        """(delta, same, f1, f2) of hashed partners."""
        wide = rows.where("y IS NOT NULL").select("id", F.concat(x, F.array(F.col("y").cast("double"), F.coalesce("fold", F.lit(-2)).cast("double"))).alias("x"))
        met = hashed_partners(wide, self.seed, self.partners)
        p = F.size("x") - 2
        delta = F.zip_with(F.slice("x", F.lit(1), p), F.slice("x2", F.lit(1), p), lambda a, b: a - b)
        last = lambda c, k: F.element_at(c, -k)
        return met.select(delta.alias("delta"), (last("x", 2) == last("x2", 2)).alias("same"), last("x", 1).cast("int").alias("f1"), last("x2", 1).cast("int").alias("f2"))

    def start(self, p: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([np.full(p, 1 / np.sqrt(p)), 0.1 / np.sqrt(p) * rng.standard_normal(self.rank * p), [1.0]])

    def sums(self, pairs, theta: np.ndarray, folds: int) -> np.ndarray:
        """Pairs, loss and gradient of every model, a row each."""
        held, ridge = pairs.sparkSession.sparkContext.broadcast(theta), self.ridge

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(held.value), held.value.shape[1] + 2))
            for batch in batches:
                if not len(batch):
                    continue
                delta, same = np.stack(batch["delta"].to_numpy()), batch["same"].to_numpy()
                for m in range(len(total)):
                    seen = (batch["f1"].to_numpy() != m - 1) & (batch["f2"].to_numpy() != m - 1)
                    if seen.any():
                        loss, gradient = loss_and_gradient(held.value[m], delta[seen], same[seen], ridge)
                        total[m] += np.concatenate([[seen.sum(), loss], gradient])
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

        rows = pairs.mapInPandas(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # p (rank + 1) + 3 numbers per model
        out = np.zeros(theta.shape[0] * (theta.shape[1] + 2))
        out[rows["k"].to_numpy()] = rows["v"].to_numpy()
        return out.reshape(theta.shape[0], -1)

    def descend(self, pairs, p: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
        """The parameters of model -1, 0, 1, ... and the mean loss before each round."""
        theta = np.tile(self.start(p), (folds + 1, 1))
        first, second, losses = np.zeros_like(theta), np.zeros_like(theta), []
        for t in range(1, self.rounds + 1):
            found = self.sums(pairs, theta, folds)
            n = np.maximum(found[:, :1], 1)
            losses.append(found[:, 1] / n[:, 0])
            g = found[:, 2:] / n
            first, second = DECAY * first + (1 - DECAY) * g, DECAY2 * second + (1 - DECAY2) * g * g
            theta = theta - self.rate * (first / (1 - DECAY**t)) / (np.sqrt(second / (1 - DECAY2**t)) + TINY)
        return theta, np.array(losses)

    def fit(self, rows, folds, x="x"):
        pairs = cut_lineage(self.pairs(rows, x), "metric-pairs")
        first = pairs.select(F.size("delta").alias("p")).first()
        if first is None:
            raise ValueError("there are no pairs of rows to learn from")
        theta, _ = self.descend(pairs, first.p, folds)
        out = [(m - 1, np.abs(s).tolist(), turn.tolist()) for m, (s, turn, _) in enumerate(unpacked(v, first.p) for v in theta)]
        return rows.sparkSession.createDataFrame(out, "model int, weights array<double>, turn array<array<double>>")  # (rank + 1) p numbers per model

    def block(self, x, state):
        return F.concat(F.zip_with(x, state["weights"], lambda a, w: a * w), E.dots(state["turn"], x))

    def features(self, width):
        return [*[f"metric_{j}" for j in range(width)], *[f"turned_{k}" for k in range(self.rank)]]
