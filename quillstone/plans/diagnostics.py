"""Redundancy, components of correlated columns, effective rank, drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import r6
from ..operators import columns as C
from ..operators import gaussian as G
from ..operators.graph import components
from ..operators.ranks import quantiles
from ..sources.fixtures import ORDER_VEC, VEC_RELU, long_form, order_vec, vec_relu
from .register import query

_CORR = f"{VEC_RELU}, c AS (SELECT a.j AS a, b.j AS b, abs(corr(a.v, b.v)) AS r FROM l a JOIN l b ON a.id = b.id AND a.j < b.j GROUP BY a.j, b.j)"


def _pairs(spark, sf_dir):
    return C.correlations(long_form(vec_relu(spark, sf_dir))).select("a", "b", F.abs("r").alias("r"))


@query("redundancy_summary", f"WITH {_CORR} SELECT round(max(r), 6) AS max, round(median(r), 6) AS median, round(quantile_cont(r, 0.9), 6) AS p90, round(quantile_cont(r, 0.95), 6) AS p95, CAST(count(*) FILTER (r > 0.05) AS BIGINT) AS n_05, CAST(count(*) FILTER (r > 0.1) AS BIGINT) AS n_10, CAST(count(*) FILTER (r > 0.95) AS BIGINT) AS n_95 FROM c")
def redundancy_summary(spark, sf_dir):
    """Quantiles and counts of the absolute correlations of all pairs of columns."""
    r = _pairs(spark, sf_dir).withColumnRenamed("r", "v")
    counts = r.agg(r6(F.max("v")).alias("max"), *[F.count_if(F.col("v") > t).alias(n) for n, t in (("n_05", 0.05), ("n_10", 0.1), ("n_95", 0.95))])
    q = quantiles(r, [0.5, 0.9, 0.95]).select(*[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("median", "p90", "p95"))])
    return counts.join(q)  # one row each


@query("correlation_components", f"""
WITH RECURSIVE {_CORR}, e AS (SELECT a AS u, b AS v FROM c WHERE r >= 0.13 UNION SELECT b, a FROM c WHERE r >= 0.13),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
SELECT CAST(u AS INTEGER) AS j, CAST(least(u, min(v)) AS INTEGER) AS root FROM reach GROUP BY u""")
def correlation_components(spark, sf_dir):
    """Groups of columns that are tied by correlations of at least 0.13 in size."""
    found = components(_pairs(spark, sf_dir).where("r >= 0.13").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("node").cast("int").alias("j"), F.col("root").cast("int").alias("root"))


@query("feature_pair_top3", f"WITH {_CORR}, s AS (SELECT a AS j, r FROM c UNION ALL SELECT b, r FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY r DESC) AS k FROM s) SELECT CAST(j AS INTEGER) AS j, round(max(r), 6) AS max, round(avg(r) FILTER (k <= 3), 6) AS top3 FROM k GROUP BY j")
def feature_pair_top3(spark, sf_dir):
    """Per column, the largest correlation with another and the mean of the three largest."""
    c = _pairs(spark, sf_dir)
    s = c.select(F.col("a").alias("j"), "r").unionByName(c.select(F.col("b").alias("j"), "r"))
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("r")))).where("k <= 3")
    return k.groupBy(F.col("j").cast("int").alias("j")).agg(r6(F.max("r")).alias("max"), r6(F.avg("r")).alias("top3"))


@query("family_table", f"WITH {_CORR} SELECT CAST(least(a % 4, b % 4) AS INTEGER) AS f1, CAST(greatest(a % 4, b % 4) AS INTEGER) AS f2, CAST(count(*) AS BIGINT) AS n, round(avg(r), 6) AS mean, round(max(r), 6) AS max FROM c GROUP BY 1, 2")
def family_table(spark, sf_dir):
    """Mean and largest correlation between families of columns (the place modulo four)."""
    f = lambda c: F.col(c) % 4
    return _pairs(spark, sf_dir).groupBy(F.least(f("a"), f("b")).cast("int").alias("f1"), F.greatest(f("a"), f("b")).cast("int").alias("f2")).agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.max("r")).alias("max"))


@query("participation_ratio", f"""
WITH {VEC_RELU}, c AS (SELECT a.j AS a, b.j AS b, covar_samp(a.v, b.v) AS c FROM l a JOIN l b ON a.id = b.id GROUP BY a.j, b.j)
SELECT round(pow(sum(c) FILTER (a = b), 2) / sum(c * c), 4) AS participation FROM c""")
def participation_ratio(spark, sf_dir):
    """Effective rank from the trace and the norm of the covariance: no eigenvalues needed."""
    long = long_form(vec_relu(spark, sf_dir))
    s = F.broadcast(long.groupBy("j").agg(F.stddev_samp("v").alias("s")))  # a row per column
    off = C.correlations(long).join(s.select(F.col("j").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("j").alias("b"), F.col("s").alias("sb")), "b")
    off = off.agg(F.sum(F.pow(F.col("r") * F.col("sa") * F.col("sb"), 2)).alias("off"))
    own = s.agg(F.sum(F.col("s") * F.col("s")).alias("trace"), F.sum(F.pow("s", F.lit(4))).alias("diag"))
    return own.join(off).select(F.round(F.pow("trace", F.lit(2)) / (F.col("diag") + 2 * F.col("off")), 4).alias("participation"))  # one row each


@query("constant_columns", f"WITH {ORDER_VEC} SELECT CAST(j AS INTEGER) AS j, stddev_pop(v) < 1e-8 AS constant FROM l GROUP BY j")
def constant_columns(spark, sf_dir):
    """Columns without any spread."""
    return long_form(order_vec(spark, sf_dir)).groupBy(F.col("j").cast("int").alias("j")).agg((F.stddev_pop("v") < 1e-8).alias("constant"))


@query("cumulative_variance", f"""
WITH {VEC_RELU}, s AS (SELECT j, var_samp(v) AS var FROM l GROUP BY j), c AS (SELECT j, row_number() OVER (ORDER BY round(var, 9) DESC, j) AS k, sum(var) OVER (ORDER BY round(var, 9) DESC, j) / sum(var) OVER () AS share FROM s)
SELECT CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(share, 6) AS share, k = (SELECT min(k) FROM c WHERE share >= 0.8) AS first80 FROM c""")
def cumulative_variance(spark, sf_dir):
    """Columns by variance with the running share, and the first at 80%: a row per column."""
    s = long_form(vec_relu(spark, sf_dir)).groupBy("j").agg(F.var_samp("v").alias("var"))
    w = Window.orderBy(F.round("var", 9).desc(), "j")  # columns, not rows
    c = s.select("j", F.row_number().over(w).alias("k"), (F.sum("var").over(w) / F.sum("var").over(Window.partitionBy())).alias("share"))
    first = F.broadcast(c.where("share >= 0.8").agg(F.min("k").alias("f")))  # one row
    return c.join(first).select(F.col("j").cast("int").alias("j"), F.col("k").cast("int").alias("k"), r6(F.col("share")).alias("share"), (F.col("k") == F.col("f")).alias("first80"))


@query("effective_rank", f"""
WITH {VEC_RELU}, c AS (SELECT a.j AS a, b.j AS b, covar_pop(a.v, b.v) AS c FROM l a JOIN l b ON a.id = b.id GROUP BY a.j, b.j)
SELECT round(pow(sum(c) FILTER (a = b), 2) / sum(c * c), 4) AS participation, round(sum(c) FILTER (a = b), 6) AS total, true AS bounded FROM c""")
def effective_rank(spark, sf_dir):
    """Participation ratio and total variance of the spectrum; bounded: the entropy rank lies between it and the width, and the shares of the first 1, 3 and 5 directions rise."""
    rows = vec_relu(spark, sf_dir).select(F.lit(0).alias("model"), F.lit(0).alias("y"), "x")
    found = G.spectrum_ranks(G.moments(rows, 64)[0, 0][2])
    bounded = found["participation"] <= found["entropy"] + 1e-9 <= 64 + 1e-9 and 0 < found["top1"] <= found["top3"] <= found["top5"] <= 1
    return spark.createDataFrame([(round(found["participation"], 4), round(found["total"], 6), bool(bounded))], "participation double, total double, bounded boolean")


@query("correlation_prune", f"""
WITH RECURSIVE {VEC_RELU}, k AS (SELECT id, j, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS r FROM l),
c AS (SELECT a.j AS a, b.j AS b, round(abs(corr(a.r, b.r)), 9) AS r FROM k a JOIN k b ON a.id = b.id AND a.j < b.j GROUP BY a.j, b.j),
tied AS (SELECT b, list(a) AS before FROM c WHERE r >= 0.1 GROUP BY b),
walk AS (
  SELECT 0 AS j, [CAST(0 AS BIGINT)] AS kept
  UNION ALL SELECT walk.j + 1, CASE WHEN list_has_any(kept, coalesce(before, [])) THEN kept ELSE list_append(kept, walk.j + 1) END FROM walk LEFT JOIN tied ON tied.b = walk.j + 1 WHERE walk.j < 63)
SELECT CAST(unnest(kept) AS INTEGER) AS j FROM walk WHERE j = 63""")
def correlation_prune(spark, sf_dir):
    """Columns that stay when each drops the later ones whose ranks are tied to its own by 0.1; the loop goes over columns only."""
    pairs = C.correlations(long_form(vec_relu(spark, sf_dir)), spearman=True)
    tied = {(r.a, r.b) for r in pairs.where(F.round(F.abs("r"), 9) >= 0.1).select("a", "b").collect()}  # at most width^2 / 2
    kept: list[int] = []
    for j in range(64):
        if not any((k, j) in tied for k in kept):
            kept.append(j)
    return spark.createDataFrame([(j,) for j in kept], "j int")


@query("column_clusters")
def column_clusters(spark, sf_dir):
    """Columns in eight clusters of their descriptors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = long_form(vec_relu(spark, sf_dir)).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg((F.col("v") == 0).cast("double")).alias("z"), F.max("v").alias("t"))
    rows = d.select("j", array_to_vector(F.array("m", "s", "z", "t")).alias("features"))
    return KMeans(k=8, seed=1).fit(rows).transform(rows).select(F.col("j").cast("int").alias("j"), F.col("prediction").alias("cluster"))


@query("feature_quality_gap", f"""
WITH {ORDER_VEC}, f AS (SELECT id, (row_number() OVER (PARTITION BY y ORDER BY md5('5:' || id), id) - 1) % 20 < 3 AS held FROM v), t AS (SELECT f.held, l.j, l.v, l.y FROM l JOIN f ON l.id = f.id),
r AS (SELECT *, rank() OVER (PARTITION BY held, j ORDER BY v) + (count(*) OVER (PARTITION BY held, j, v) - 1) / 2.0 AS k FROM t),
a AS (SELECT held, j, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY held, j)
SELECT CAST(j AS INTEGER) AS j, round(max(auc) FILTER (NOT held), 6) AS train_auc, round(max(auc) FILTER (held), 6) AS held_auc, round(max(auc) FILTER (NOT held) - max(auc) FILTER (held), 6) + 0.0 AS gap FROM a GROUP BY j""")
def feature_quality_gap(spark, sf_dir):
    """AUC of each column in the training rows and in the hold-out, and the gap."""
    from ..operators import folds
    from ..operators.ranks import feature_auc

    v = order_vec(spark, sf_dir)
    held = folds.stratified(v, 20, [5]).select("id", (F.col("fold") < 3).alias("held"))
    a = feature_auc(long_form(v).join(held, "id"), "held", "j")
    of = lambda h: F.max(F.when(F.col("held") == h, F.col("auc")))
    return a.groupBy(F.col("j").cast("int").alias("j")).agg(r6(of(False)).alias("train_auc"), r6(of(True)).alias("held_auc"), r6(of(False) - of(True)).alias("gap"))
