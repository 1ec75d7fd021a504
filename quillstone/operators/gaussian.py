"""Class-conditional Gaussian features: shrunk covariances, Mahalanobis, LDA, QDA, PPCA and PCA.

Spark sums the moments of each (model, class); what reaches the driver is one mean and one
p x p matrix per model and class, whatever the number of rows.  The small algebra happens
there, and the matrices go back to score the rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

EPS = 1e-10
LAMBDAS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)  # fixed values: blends of pooled and class covariance


def moments(train: DataFrame, p: int) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """(model, class): rows, mean and covariance (ddof 0) of train (model, y, x)."""
    first = train.select("x").first()
    if first is None:
        return {}
    shift = np.array(first.x, float)  # sums of products lose digits if the mean is large

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, g in batch.groupby(["model", "y"]):
                x = np.stack(g["x"].to_numpy()) - shift
                s = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                sums[key] = sums[key] + s if key in sums else s
        for (model, y), s in sums.items():
            yield pd.DataFrame({"model": model, "y": y, "k": np.arange(len(s)), "s": s})

    rows = train.select("model", "y", "x").mapInPandas(partial, "model int, y int, k int, s double").groupBy("model", "y", "k").agg(F.sum("s").alias("s")).toPandas()  # p^2 rows per model and class
    out = {}
    for (model, y), g in rows.groupby(["model", "y"]):
        s = g.sort_values("k")["s"].to_numpy()
        n, mean = s[0], s[1 : p + 1] / s[0]
        out[int(model), int(y)] = (int(n), shift + mean, s[p + 1 :].reshape(p, p) / n - np.outer(mean, mean))
    return out


def together(found: dict, model: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of all classes of a model in one."""
    parts = [v for (m, _), v in found.items() if m == model]
    n = sum(k for k, _, _ in parts)
    mean = sum(k * m for k, m, _ in parts) / n
    return n, mean, sum(k * (c + np.outer(m - mean, m - mean)) for k, m, c in parts) / n


def shrinkage(train: DataFrame, found: dict) -> dict[tuple[int, int], tuple[int, float, float]]:
    """(model, y): rows, mean variance, and the Ledoit-Wolf weight of the scaled identity, in closed form; found: the moments.

    Besides the covariance it needs the mean of the fourth power of the centred norm.
    """
    spark = train.sparkSession
    means = spark.createDataFrame([(m, y, mean.tolist()) for (m, y), (_, mean, _) in found.items()], "model int, y int, c array<double>")
    z = F.zip_with("x", "c", lambda a, b: a - b)
    centred = train.select("model", "y", "x").join(F.broadcast(means), ["model", "y"]).select("model", "y", z.alias("z"))  # a row per model and class
    out = {}
    for r in centred.groupBy("model", "y").agg(F.avg(F.pow(V.dot(F.col("z"), F.col("z")), F.lit(2))).alias("fourth")).collect():  # a row per model and class
        n, _, cov = found[r.model, r.y]
        p, trace, norm = len(cov), float(np.trace(cov)), float((cov * cov).sum())
        beta, delta = (r.fourth - norm) / (p * n), (norm - trace * trace / p) / p
        out[r.model, r.y] = (n, trace / p, min(beta, delta) / delta if delta else 0.0)
    return out


def shrunk(cov: np.ndarray, weight: float) -> np.ndarray:
    return (1 - weight) * cov + weight * np.trace(cov) / len(cov) * np.eye(len(cov))


def floored(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (not below 1e-10 of the largest) and vectors, the largest first."""
    value, vector = np.linalg.eigh(cov)
    return np.maximum(value, max(value.max() * 1e-10, EPS))[::-1], vector[:, ::-1]


def spectrum_ranks(cov: np.ndarray) -> dict[str, float]:
    """How many directions a covariance has in effect: participation ratio, exponent of the entropy, shares of the first ones."""
    value = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    share = value / max(value.sum(), EPS)
    used = share[share > 0]
    return {"total": float(value.sum()), "participation": float(1 / (share**2).sum()), "entropy": float(np.exp(-(used * np.log(used)).sum())), **{f"top{k}": float(share[:k].sum()) for k in (1, 3, 5)}}


def precision(cov: np.ndarray) -> np.ndarray:
    value, vector = floored(cov)
    return vector / value @ vector.T


def root_inverse(cov: np.ndarray) -> np.ndarray:
    value, vector = floored(cov)
    return vector / np.sqrt(value) @ vector.T


def unit(w: np.ndarray) -> np.ndarray:
    return w / (np.linalg.norm(w) + EPS)


def class_state(n: list[int], mean: list[np.ndarray], cov: list[np.ndarray], weight: list[float], every: np.ndarray) -> dict:
    """What the scores of one model need; every: the shrunk covariance of all its rows."""
    p = len(mean[0])
    own = [shrunk(c, w) for c, w in zip(cov, weight)]
    pooled = sum(k * c for k, c in zip(n, own)) / sum(n)
    inverse = precision(pooled)
    state = {"mean": mean, "own": [precision(c) for c in own], "logdet": [float(np.log(floored(c)[0]).sum()) for c in own], "lda": inverse @ (mean[1] - mean[0]), "mid": (mean[0] + mean[1]) / 2, "prior": float(np.log(n[1] / n[0]))}
    state["rda"] = [[precision((1 - t) * every + t * c) for c in own] for t in LAMBDAS]
    state["whitener"] = root_inverse(every)
    state["axes"] = {"mid": unit(mean[1] - mean[0]), "fisher": unit(state["whitener"] @ (mean[1] - mean[0]))}
    state["ppca"] = []
    for k in sorted({max(1, p // d) for d in (16, 8, 4, 2)}):
        pair = []
        for m, c in zip(mean, cov):
            value, vector = floored(c)
            rest = float(value[k:].mean()) if k < p else EPS
            pair.append((m, vector[:, :k], value[:k], rest, float(np.log(value[:k]).sum() + (p - k) * np.log(rest))))
        state["ppca"].append((k, pair))
    return state


def along(z: np.ndarray, axis: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Place along a unit axis, distance from it, cosine, and their ratio per dimension."""
    place, square = z @ axis, (z * z).sum(1)
    off = np.sqrt(np.maximum(square - place**2, 0))
    return {f"{name}_axis": place, f"{name}_orth": off, f"{name}_cos": place / (np.sqrt(square) + EPS), f"{name}_axis_snr": place / (off / np.sqrt(max(z.shape[1] - 1, 1)) + EPS)}


def scores(x: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """The features of the rows x under one model."""
    quad = lambda m, q: np.einsum("ij,jk,ik->i", x - m, q, x - m)
    d0, d1 = (quad(m, q) for m, q in zip(s["mean"], s["own"]))
    out = {"lda": (x - s["mid"]) @ s["lda"] + s["prior"], "qda": 0.5 * (d0 - d1 + s["logdet"][0] - s["logdet"][1]) + s["prior"], "mahal_0": np.sqrt(d0), "mahal_1": np.sqrt(d1), "mahal_diff": np.sqrt(d0) - np.sqrt(d1)}
    out |= {"mahal_sq_0": d0, "mahal_sq_1": d1, "mahal_sq_diff": d0 - d1, "mahal_norm_diff": (d0 - d1) / (d0 + d1 + EPS), "mahal_log_ratio": np.log((d0 + EPS) / (d1 + EPS))}
    for t, (q0, q1) in zip(LAMBDAS, s["rda"]):
        r0, r1 = quad(s["mean"][0], q0), quad(s["mean"][1], q1)
        out[f"rda_{t:g}"], out[f"rda_norm_{t:g}"] = r0 - r1, (r0 - r1) / (r0 + r1 + EPS)
    centred = x - s["mid"]
    out |= along(centred, s["axes"]["mid"], "mid") | along(centred @ s["whitener"], s["axes"]["fisher"], "fisher")
    for k, pair in s["ppca"]:
        logp, rebuilt = [], []
        for m, vector, value, rest, logdet in pair:
            z = x - m
            t = z @ vector
            left = np.maximum((z * z).sum(1) - (t * t).sum(1), 0)
            logp.append(-0.5 * ((t * t / value).sum(1) + left / rest + logdet + len(m) * np.log(2 * np.pi)))
            rebuilt.append(np.sqrt(left))
        out |= {f"ppca_logp0_{k}": logp[0], f"ppca_logp1_{k}": logp[1], f"ppca_llr_{k}": logp[1] - logp[0], f"subspace_diff_{k}": rebuilt[0] - rebuilt[1]}
    return out


def score_rows(rows: DataFrame, states: dict[int, dict]) -> DataFrame:
    """(id, model, name, value) of rows (id, model, x), each under its own model."""
    held = rows.sparkSession.sparkContext.broadcast(states)  # a few p x p matrices per model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, g in batch.groupby("model"):
                for name, value in scores(np.stack(g["x"].to_numpy()), held.value[int(model)]).items():
                    yield pd.DataFrame({"id": g["id"], "model": model, "name": name, "value": value})

    return rows.select("id", "model", "x").mapInPandas(run, "id long, model int, name string, value double")


def whiten(rows: DataFrame, mean: np.ndarray, cov: np.ndarray, k: int) -> DataFrame:
    """(id, z): the first k principal coordinates at unit variance; the largest loading of each is positive."""
    value, vector = floored(cov)
    if value[k - 1] < EPS:
        raise ValueError("fewer directions with variance than asked")
    vector = vector[:, :k] * np.sign(vector[np.abs(vector[:, :k]).argmax(0), np.arange(k)])
    turn = vector / np.sqrt(value[:k])
    held = rows.sparkSession.sparkContext.broadcast((mean, turn))  # one p x k matrix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, t = held.value
            yield pd.DataFrame({"id": batch["id"], "z": list((np.stack(batch["x"].to_numpy()) - m) @ t)})

    return rows.select("id", "x").mapInPandas(run, "id long, z array<double>")
