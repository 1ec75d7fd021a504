"""Isotonic regression of labels on millions of distinct values.

The fit of a sequence follows from the fits of its parts: pooling adjacent violators of pooled
parts gives the same blocks as pooling all values at once.  Values are counted first; each
group's range is cut into steps, every step is pooled by a task that holds a stack of blocks only, and the
blocks of all steps, far fewer than values, are pooled once more by group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coordinates as K
from .estimators import Estimator


def _pool(rows: DataFrame, *by: str) -> DataFrame:
    """(by, lo, hi, n, pos): blocks with rising shares pos / n; rows: by (int), lo, hi, n, pos."""
    columns = [*by, "lo", "hi", "n", "pos"]
    types = [*[pa.int32()] * len(by), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*key, *b) for b in done], strict=True), types, strict=True)], columns)

        for batch in batches:
            for *k, lo, hi, n, pos in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if stack:
                        yield out(stack)
                    key, stack = k, []
                while stack and stack[-1][3] * n >= pos * stack[-1][2]:  # exact: shares as fractions
                    low, _, m, p = stack.pop()
                    lo, n, pos = low, n + m, pos + p
                stack.append((lo, hi, n, pos))
        if stack:
            yield out(stack)

    schema = ", ".join([*[f"{c} int" for c in by], "lo double, hi double, n long, pos long"])
    return rows.repartition(*by).sortWithinPartitions(*by, "lo").select(*columns).mapInArrow(pooled, schema)


def blocks(counts: DataFrame, *by: str, steps: int = 64) -> DataFrame:
    """(by, lo, hi, n, pos) of the rising fit of pos / n over v; counts: by (int), v, n, pos, a row per value."""
    spans = counts.groupBy(*by).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / (steps - 1), F.lit(1e-300))
    cut = counts.join(F.broadcast(spans), list(by)).withColumn("__step", F.floor((F.col("v") - F.col("__lo")) / width).cast("int"))  # a row per group
    parts = _pool(cut.select(*by, "__step", F.col("v").alias("lo"), F.col("v").alias("hi"), "n", "pos"), *by, "__step")
    return _pool(parts.drop("__step"), *by)


@dataclass(frozen=True)
class Isotonic(Estimator):
    """The share of class 1 as a monotone function of each coordinate, or its logit; the direction is that of the coordinate's AUC.

    Between two blocks in proportion, outside the training range the first or last share; shares are kept `clip`
    away from 0 and 1.
    """

    clip: float = 1e-4
    logit: bool = True
    name: str = "isotonic"

    def fit(self, rows, folds, x="x"):
        train = K.training_counts(rows.where("y IS NOT NULL").select("id", "y", "fold", F.posexplode(x).alias("j", "v")), folds)
        up = F.broadcast(K.strengths(train).select("model", "j", F.when(F.col("auc") >= 0.5, 1.0).otherwise(-1.0).alias("sign")))  # a row per model and column
        counts = train.join(up, ["model", "j"]).groupBy("model", "j", (F.col("v") * F.col("sign")).alias("v")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).cast("long").alias("pos"))
        found = blocks(counts.select(F.col("model").cast("int"), F.col("j").cast("int"), "v", "n", "pos"), "model", "j").withColumn("p", F.col("pos") / F.col("n"))
        ends = found.groupBy("model", "j").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "p"))).alias("b"))  # blocks: fractions of counts, far fewer than values
        points = F.flatten(F.transform("b", lambda t: F.when(t["lo"] < t["hi"], F.array(F.struct(t["lo"].alias("v"), t["p"].alias("p")), F.struct(t["hi"].alias("v"), t["p"].alias("p")))).otherwise(F.array(F.struct(t["lo"].alias("v"), t["p"].alias("p"))))))
        return ends.join(up, ["model", "j"]).select("model", "j", "sign", points.alias("at")).select("model", "j", "sign", F.col("at.v").alias("vs"), F.col("at.p").alias("ps"))

    def transform(self, rows, state, to, x="x"):
        found: dict = {}
        for r in state.collect():  # a row per model and column
            found.setdefault(r.model, {})[r.j] = (r.sign, np.array(r.vs), np.array(r.ps))
        held, clip, logit = rows.sparkSession.sparkContext.broadcast(found), self.clip, self.logit

        @F.pandas_udf("array<double>")
        def scored(model: pd.Series, vec: pd.Series) -> pd.Series:
            out: list = [None] * len(vec)
            for m in model.unique():
                at, of = np.flatnonzero(model.to_numpy() == m), held.value[int(m)]
                v = np.stack(vec.iloc[at].to_numpy())
                p = np.stack([np.interp(v[:, j] * of[j][0], of[j][1], of[j][2]) for j in range(v.shape[1])], axis=1)
                p = np.clip(p, clip, 1 - clip)
                for i, row in zip(at, (np.log(p / (1 - p)) if logit else p).tolist(), strict=True):
                    out[i] = row
            return pd.Series(out, dtype=object)

        return rows.withColumn(to, scored("model", x))

    def features(self, width):
        return [f"isotonic_{j}" for j in range(width)]
