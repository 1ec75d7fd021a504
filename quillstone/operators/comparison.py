"""Scores of several models over repeated folds: ranks, blends, paired statistics and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_rank_by_counts, feature_auc


def ranked(oof: DataFrame, *by: str) -> DataFrame:
    """oof with `r`: the average rank of its score inside the groups, over their size."""
    ranks = average_rank_by_counts(oof, "score", *by)
    sizes = F.broadcast(oof.groupBy(*by).agg(F.count("*").alias("__size")))  # a row per group
    return oof.join(ranks.select(*by, "score", "rank"), [*by, "score"]).join(sizes, list(by)).withColumn("r", F.col("rank") / F.col("__size")).drop("rank", "__size")


def fold_auc(oof: DataFrame, *by: str) -> DataFrame:
    return feature_auc(oof, *by, score="score")


def normalized(config: DataFrame) -> DataFrame:
    """config(name, model, weight) with weights that sum to one; negative or no weight is an error."""
    total = F.sum("weight").over(Window.partitionBy("name"))
    least = F.min("weight").over(Window.partitionBy("name"))
    good = (least >= 0) & (total > 0) & (total < float("inf"))
    return config.withColumn("weight", F.when(good, F.col("weight") / total).otherwise(F.raise_error(F.concat(F.lit("the weights are not usable in "), "name"))))


def sums_to_one(config: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """config(name, model, weight) as it is; weights that are negative or do not sum to one are an error."""
    total = F.sum("weight").over(Window.partitionBy("name"))
    least = F.min("weight").over(Window.partitionBy("name"))
    good = (least >= 0) & (F.abs(total - 1) <= tolerance)
    return config.withColumn("weight", F.when(good, F.col("weight")).otherwise(F.raise_error(F.concat(F.lit("the weights do not sum to one in "), "name"))))


def rank_blend(ranks: DataFrame, config: DataFrame, *key: str) -> DataFrame:
    """(name, key, score): weighted sums of the ranks r of each model for every configuration; one query for all."""
    used = F.broadcast(normalized(config).where("weight > 0"))  # a row per model and configuration
    return ranks.join(used, "model").groupBy("name", *key).agg(F.sum(F.col("weight") * F.col("r")).alias("score"))


def paired(auc: DataFrame, baseline, tolerance: float = 1e-12) -> DataFrame:
    """Differences of each model to the baseline over the same folds: moments, wins, losses, ties and the signed-rank sum."""
    base = auc.where(F.col("model") == baseline).select("repeat", "fold", F.col("auc").alias("base"))
    d = auc.where(F.col("model") != baseline).join(base, ["repeat", "fold"]).select("model", "repeat", "fold", F.round(F.col("auc") - F.col("base"), 12).alias("d"))
    nonzero = average_rank_by_counts(d.where("d <> 0").withColumn("a", F.abs("d")), "a", "model").select("model", "a", "rank")
    signed = d.withColumn("a", F.abs("d")).join(nonzero, ["model", "a"], "left")
    return signed.groupBy("model").agg(
        F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.median("d").alias("median"), F.min("d").alias("min"), F.max("d").alias("max"),
        F.count_if(F.col("d") > tolerance).alias("wins"), F.count_if(F.col("d") < -tolerance).alias("losses"), F.count_if(F.abs("d") <= tolerance).alias("ties"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.count_if(F.col("d") != 0).alias("n_nonzero"),
    )


def _signed_ranks(differences: list[float]) -> list[tuple[int, bool]]:
    """Twice the rank of each difference's size, and whether it is positive; zeros are left out, ties share the mean of their ranks."""
    d = sorted((abs(x), x > 0) for x in differences if x)
    out, k = [], 0
    while k < len(d):
        same = sum(a == d[k][0] for a, _ in d)
        out += [(2 * k + same + 1, up) for _, up in d[k : k + same]]
        k += same
    return out


def signed_rank_sum(differences: list[float]) -> float:
    return sum(r for r, up in _signed_ranks(differences) if up) / 2


def signed_rank_p(differences: list[float]) -> float:
    """Two-sided exact p of the signed-rank sum, ties and zeros allowed; 1 if all are zero.  differences: one per fold."""
    ranks = _signed_ranks(differences)
    ways = [1] + [0] * sum(r for r, _ in ranks)
    for r, _ in ranks:
        for at in range(len(ways) - 1, r - 1, -1):
            ways[at] += ways[at - r]
    plus = sum(r for r, up in ranks if up)
    low = min(plus, len(ways) - 1 - plus)
    return min(1.0, 2 * sum(ways[: low + 1]) / 2 ** len(ranks)) if ranks else 1.0


def wilcoxon_p(w_plus: float, n: int) -> float:
    """Two-sided exact p of the signed-rank sum for n differences without ties; 1 for none."""
    ways = [1]
    for k in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if i >= k else 0) for i in range(len(ways) + k)]
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    return min(1.0, 2 * sum(c for i, c in enumerate(ways) if i <= low) / 2**n) if n else 1.0


def select_simplest(table: DataFrame, tolerance: float) -> DataFrame:
    """Within the tolerance of the best mean: the most raw weight, then the fewest blocks, then the best mean."""
    best = F.broadcast(table.agg(F.max("cv").alias("best")))  # one row
    return table.join(best).where(F.col("cv") >= F.col("best") - tolerance).orderBy(F.desc("raw_weight"), "blocks", F.desc("cv"), "name").limit(1).drop("best")
