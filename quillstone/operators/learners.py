"""Classifiers under out-of-fold scoring.

Trees, boosting, logistic models and networks are Spark ML's.  Kernel machines are linear
machines on random Fourier features: the inner product of two rows' features is the kernel
in expectation, blocks weighted by the square root of their weight add kernels up, and the
fit is distributed, which an n x n Gram matrix is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .parallel import side_by_side


def fourier(rows: DataFrame, parts: list[tuple[int, int, float, float]], features: int = 256, seed: int = 5) -> DataFrame:
    """rows with x replaced by features of the kernel: the sum over parts (first, last, weight, gamma) of weight exp(-gamma d2)."""
    rng = np.random.default_rng(seed)
    waves = [(a, b, np.sqrt(2 * w / features), rng.standard_normal((b - a, features)) * np.sqrt(2 * g), rng.uniform(0, 2 * np.pi, features)) for a, b, w, g in parts]
    others = [c for c in rows.columns if c != "x"]
    held = rows.sparkSession.sparkContext.broadcast(waves)  # p x features numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy())
            z = np.concatenate([s * np.cos(x[:, a:b] @ w + shift) for a, b, s, w, shift in held.value], axis=1)
            yield batch.assign(x=list(z))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others) + ", x array<double>"
    return rows.select(*others, "x").mapInPandas(run, schema)


def prepared(rows: DataFrame) -> DataFrame:
    """features and label columns for Spark ML."""
    return rows.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))


def positive(scored: DataFrame) -> DataFrame:
    """(id, y, score): probability of class 1, or the margin where a model gives none."""
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select("id", "y", vector_to_array(column)[1].alias("score"))


def out_of_fold(rows: DataFrame, estimator, folds: int) -> DataFrame:
    """(id, y, fold, score): each row scored by the model fitted on the other folds; rows: id, y, fold, x."""
    data = cut_lineage(rows.select("id", "y", "fold", "x"), "fold-rows")  # fits read them many times
    data = prepared(data)
    models = side_by_side([partial(estimator.fit, data.where(F.col("fold") != f)) for f in range(folds)])
    parts = [positive(m.transform(data.where(F.col("fold") == f))).withColumn("fold", F.lit(f)) for f, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def by_fold(rows: DataFrame, folds: int, scored) -> DataFrame:
    """The rows of every fold as scored(rows of the other folds, rows of the fold) returns them, with their fold."""
    rows = cut_lineage(rows, "fold-rows")  # fits read them many times
    parts = side_by_side([partial(scored, rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)) for f in range(folds)])
    return reduce(DataFrame.unionByName, [p.withColumn("fold", F.lit(f)) for f, p in enumerate(parts)])


def mixture_state(mixture) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Constant, mean and whitening matrix of each component of a fitted Gaussian mixture."""
    parts = mixture.gaussiansDF.collect()  # a mean and a matrix per component
    state = []
    for w, r in zip(mixture.weights, parts):
        value, vector = np.linalg.eigh(r["cov"].toArray())
        value = np.maximum(value, 1e-10)
        state.append((np.log(w) - 0.5 * (np.log(2 * np.pi * value).sum()), r["mean"].toArray(), vector / np.sqrt(value)))
    return state


def fold_densities(rows: DataFrame, states: list[list[list[tuple[float, np.ndarray, np.ndarray]]]], names: list[str]) -> DataFrame:
    """(id, fold, names): log densities of column x under the mixtures of the row's fold, one for each name, in one pass; states: by fold, then by name."""
    held = rows.sparkSession.sparkContext.broadcast(states)  # p^2 numbers per component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, x = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            out = np.empty((len(names), len(x)))
            for f in np.unique(fold):
                at = fold == f
                for n, state in enumerate(held.value[f]):
                    each = np.stack([c - 0.5 * (((x[at] - m) @ t) ** 2).sum(1) for c, m, t in state])
                    top = each.max(0)
                    out[n, at] = top + np.log(np.exp(each - top).sum(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], ["id", "fold", *names])

    return rows.select("id", "fold", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fold int" + "".join(f", {n} double" for n in names))


def noisy_labels(oof: DataFrame) -> DataFrame:
    """(id, y, score) of rows whose label is likely wrong: the other class's probability reaches that class's mean confidence and exceeds the own one's."""
    own = F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))
    means = oof.groupBy("y").agg(F.avg(own).alias("t"))
    bar = F.broadcast(means.agg(F.max(F.when(F.col("y") == 0, F.col("t"))).alias("t0"), F.max(F.when(F.col("y") == 1, F.col("t"))).alias("t1")))  # one row
    other = F.when(F.col("y") == 1, 1 - F.col("score")).otherwise(F.col("score"))
    reach = F.when(F.col("y") == 1, F.col("t0")).otherwise(F.col("t1"))
    return oof.join(bar).where((other >= reach) & (other > own)).select("id", "y", "score")


def refitted(estimator, cleaned: bool, train: DataFrame, held: DataFrame, inner: int = 3) -> DataFrame:
    """(id, y, score, left_out): held scored by the estimator fitted on train; cleaned: without the rows whose labels its own inner folds doubt."""
    doubted = train.select("id").limit(0)
    if cleaned:
        from .folds import stratified

        fold = stratified(train, inner, [1]).select("id", F.col("fold").alias("inner"))
        rows = train.join(fold, "id").select("id", "y", F.col("inner").alias("fold"), "x")
        doubted = cut_lineage(noisy_labels(out_of_fold(rows, estimator, inner)).select("id"), "doubted-rows")
    model = estimator.fit(prepared(train.join(doubted, "id", "left_anti")))
    return positive(model.transform(prepared(held))).withColumn("left_out", F.lit(doubted.count()))


def pair_differences(rows: DataFrame, seed: int = 3) -> DataFrame:
    """(id, y, x): differences of a positive and a negative row in both directions, partners by hash order; for rankers."""
    from .folds import hashed_rank

    ranked = hashed_rank(rows.select("id", "y", "x"), seed, "id", "y")
    n = F.broadcast(rows.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")))  # one row
    size = F.greatest("n0", "n1")
    spread = ranked.join(n).withColumn("own", F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n0")))
    spread = spread.withColumn("at", F.explode(F.sequence(F.col("k"), size - 1, F.col("own")))).select("id", "y", "x", "at")  # the smaller class repeats until it has as many rows
    a = spread.where("y = 1").select("at", F.col("x").alias("x1"))
    b = spread.where("y = 0").select("at", F.col("x").alias("x0"))
    d = a.join(b, "at").select("at", F.zip_with("x1", "x0", lambda p, q: p - q).alias("x"))
    return d.select((F.col("at") * 2).alias("id"), F.lit(1).alias("y"), "x").unionByName(d.select((F.col("at") * 2 + 1).alias("id"), F.lit(0).alias("y"), F.transform("x", lambda v: -v).alias("x")))
