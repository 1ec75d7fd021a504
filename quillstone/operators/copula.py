"""Gaussian copulas of the classes: normal scores by each class's own distribution, then its correlations.

Every state is fitted without the fold that it scores.  Distributions are counts of distinct
values; what reaches the driver is one p x p matrix per model and class.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coordinates as K
from . import gaussian as G
from .graph import cut_lineage
from .ranks import count_before

CLIP = 1e-4  # fixed value: how near to 0 and 1 a share may come


def normal_scores(long: DataFrame, folds: int) -> DataFrame:
    """(model, c, j, v, z): the normal score of each value of a column under class c of each model.

    The share of a value is that of the class's rows at or below it, whether the class has the value or not.
    """

    @F.pandas_udf("double")
    def inverse_normal(u: pd.Series) -> pd.Series:
        return u.map(NormalDist().inv_cdf)

    train = K.training_counts(long, folds).where("model >= 0").groupBy("model", F.col("y").alias("c"), "j", "v").agg(F.sum("n").alias("n"))
    totals = train.groupBy("model", "c", "j").agg(F.sum("n").alias("total"))
    grid = long.select("j", "v").distinct().withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    counts = grid.join(train, ["model", "c", "j", "v"], "left").select("model", "c", "j", "v", F.coalesce("n", F.lit(0)).alias("n"))
    counts = cut_lineage(counts, "copula-counts")  # read several times
    placed = count_before(counts, "v", "model", "c", "j").join(totals, ["model", "c", "j"])
    share = (F.col("before") + F.col("n") + 0.5) / (F.col("total") + 1)
    return placed.select("model", "c", "j", "v", inverse_normal(F.least(F.greatest(share, F.lit(CLIP)), F.lit(1 - CLIP))).alias("z"))


def scores(long: DataFrame, folds: int, p: int) -> DataFrame:
    """(id, model, logp0, logp1) of each row (id, y, fold, j, v) under the copulas of the other folds."""
    long = cut_lineage(long, "copula-rows")
    z = cut_lineage(normal_scores(long, folds), "copula-scores")
    packed = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", "z"))).alias("s")).select(*by, F.col("s.z").alias("x"))
    seen = K.training(long, folds).where("model >= 0").join(z.withColumnRenamed("c", "y"), ["model", "y", "j", "v"])
    train = cut_lineage(packed(seen, "model", "y", "id"), "copula-train")
    found = G.moments(train, p)
    weights = G.shrinkage(train, found)
    state = {}
    for key, (_, _, cov) in found.items():
        own = G.shrunk(cov, weights[key][2])
        state[key] = (G.precision(own), float(np.log(G.floored(own)[0]).sum()))
    rows = packed(long.withColumnRenamed("fold", "model").drop("y").join(z, ["model", "j", "v"]), "id", "model", "c")
    held = long.sparkSession.sparkContext.broadcast(state)  # a p x p matrix per model and class

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (model, c), g in batch.groupby(["model", "c"]):
                q, logdet = held.value[int(model), int(c)]
                x = np.stack(g["x"].to_numpy())
                logp = -0.5 * (logdet + np.einsum("ij,jk,ik->i", x, q, x) - (x * x).sum(1))  # less the marginals
                yield pd.DataFrame({"id": g["id"], "model": model, "c": c, "logp": logp})

    each = rows.mapInPandas(run, "id long, model int, c int, logp double")
    return each.groupBy("id", "model").agg(*[F.max(F.when(F.col("c") == c, F.col("logp"))).alias(f"logp{c}") for c in (0, 1)])
