"""Coordinate likelihoods: zero-aware quantile bins, smoothed log ratios, isotonic smoothing and strengths.

All states are keyed by the fold they were fitted without, so a row is only scored by a
model that has not seen it.  States have a row per (fold, column, bin): they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bin_of
from .graph import cut_lineage
from .ranks import feature_auc, quantiles


def training(long: DataFrame, folds: int) -> DataFrame:
    """Rows once for each model that may see them: model f is fitted on all folds but f; model -1 on all.  Column model."""
    models = F.array(F.lit(-1), *[F.when(F.col("fold") != f, F.lit(f)) for f in range(folds)])
    return long.withColumn("model", F.explode(F.array_compact(models)))


def training_counts(long: DataFrame, folds: int) -> DataFrame:
    """The same as counts: (model, j, v, y, n).

    Equal values of a fold are counted once, before they are copied to the models, and the counts are
    written: all states of all models come from one pass over the rows.
    """
    counts = cut_lineage(long.groupBy("fold", "j", "v", "y").agg(F.count("*").alias("n")), "coordinate-counts")
    return training(counts, folds).drop("fold")


def _weight(train: DataFrame) -> str | None:
    return "n" if "n" in train.columns else None


def fit_edges(train: DataFrame, bins: int) -> DataFrame:
    """(model, j, edges)."""
    inner = [k / bins for k in range(1, bins)]
    edges = quantiles(train.where("v > 0"), inner, "model", "j", weight=_weight(train)).select("model", "j", F.array_sort(F.array_distinct("q")).alias("edges"))
    every = train.select("model", "j").distinct()
    return every.join(edges, ["model", "j"], "left").select("model", "j", F.coalesce("edges", F.array().cast("array<double>")).alias("edges"))


def fit_ratios(train: DataFrame, edges: DataFrame, alpha: float) -> DataFrame:
    """(model, j, bin, c0, c1, llr): Laplace-smoothed log ratio of the classes for every bin, empty ones too."""
    times = F.col("n") if _weight(train) else F.lit(1)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("y") == c, times)), F.lit(0)).cast("long")
    counts = train.join(F.broadcast(edges), ["model", "j"]).groupBy("model", "j", bin_of(F.col("v"), F.col("edges")).alias("bin")).agg(of(0).alias("c0"), of(1).alias("c1"))
    every = edges.select("model", "j", F.size("edges").alias("e"), F.explode(F.sequence(F.lit(0), F.size("edges") + 1)).alias("bin"))
    full = every.join(counts, ["model", "j", "bin"], "left").select("model", "j", "bin", (F.col("e") + 2).alias("b"), F.coalesce("c0", F.lit(0)).alias("c0"), F.coalesce("c1", F.lit(0)).alias("c1"))
    totals = full.groupBy("model", "j").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    share = lambda c, n: (F.col(c) + alpha) / (F.col(n) + alpha * F.col("b"))
    return full.join(totals, ["model", "j"]).select("model", "j", "bin", "c0", "c1", F.ln(share("c1", "n1") / share("c0", "n0")).alias("llr"))


def isotonic(ratios: DataFrame, increasing: DataFrame) -> DataFrame:
    """(model, j, bin, llr) with the log ratios made monotone by weighted least squares.

    The bins of a column are one small array; the fit at i is max over a <= i of min over
    b >= i of the weighted mean of a..b.  Bins without rows take the value of the bin before, or
    after at the start.  increasing: (model, j, up); a falling fit is that of the negated values.
    """
    cells = ratios.join(increasing, ["model", "j"]).withColumn("w", (F.col("c0") + F.col("c1")).cast("double")).where("w > 0")
    sign = F.when(F.col("up"), 1.0).otherwise(-1.0)
    packed = cells.groupBy("model", "j", "up").agg(F.array_sort(F.collect_list(F.struct("bin", "w", (F.col("llr") * sign).alias("v")))).alias("p"))
    n = F.size("p")
    mean = lambda a, b: F.aggregate(F.slice("p", a, b - a + 1), F.lit(0.0), lambda s, t: s + t.w * t.v) / F.aggregate(F.slice("p", a, b - a + 1), F.lit(0.0), lambda s, t: s + t.w)
    fit = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda a: F.array_min(F.transform(F.sequence(i, n), lambda b: mean(a, b))))))
    fitted = packed.select("model", "j", "up", "p", fit.alias("fit")).select("model", "j", "up", F.transform("p", lambda t, i: F.struct(t.bin.alias("bin"), F.get("fit", i).alias("v"))).alias("f"))
    bins = ratios.select("model", "j", "bin").join(fitted, ["model", "j"])
    before = F.filter("f", lambda t: t.bin <= F.col("bin"))
    value = F.when(F.size(before) > 0, F.element_at(before, -1).v).otherwise(F.get("f", F.lit(0)).v)
    return bins.select("model", "j", "bin", (value * F.when(F.col("up"), 1.0).otherwise(-1.0)).alias("llr"))


def strengths(train: DataFrame) -> DataFrame:
    """(model, j, auc, strength, place): distance of the AUC from one half and the place in its order."""
    from pyspark.sql import Window

    auc = feature_auc(train, "model", "j", weight=_weight(train)).select("model", "j", "auc", F.round(F.abs(F.col("auc") - 0.5), 9).alias("strength"))
    return auc.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("strength"), F.desc("j"))) - 1)  # a row per column


def score(rows: DataFrame, edges: DataFrame, table: DataFrame, value: str = "llr") -> DataFrame:
    """(id, model, j, value) of rows (id, model, j, v)."""
    binned = rows.join(F.broadcast(edges), ["model", "j"]).select("id", "model", "j", bin_of(F.col("v"), F.col("edges")).alias("bin"))
    return binned.join(F.broadcast(table.select("model", "j", "bin", value)), ["model", "j", "bin"]).select("id", "model", "j", value)
