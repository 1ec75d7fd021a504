"""Column statistics, groupings, distincts and duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import columns as C
from ..operators.ranks import average_rank_by_counts, quantiles
from ..sources.fixtures import DOC_VEC, ORDER_VEC, VEC_PAIRS, VEC_RELU, doc_vec, long_form, order_vec, table, vec_pairs, vec_relu
from .register import query


def column():
    """The column's number as an int."""
    return F.col("j").cast("int").alias("j")


_DESCRIBE = """
, d AS (SELECT j, count(DISTINCT v) AS n_unique, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, var_samp(v) AS var, mad(v) AS mad, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, max(v) AS max,
  skewness(v) AS skew, kurtosis(v) AS kurtosis, count(*) AS n FROM l GROUP BY j),
o AS (SELECT l.j, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM l JOIN d ON l.j = d.j GROUP BY l.j)
SELECT CAST(d.j AS INTEGER) AS j, CAST(n_unique AS BIGINT) AS n_unique, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(var, 4) AS var, round(mad, 6) AS mad, round(min, 6) AS min, round(q1, 6) AS q1, round(q3, 6) AS q3, round(max, 6) AS max, round(q3 - q1, 6) AS iqr,
  CAST(outliers AS BIGINT) AS outliers, round(outliers * 100.0 / n, 2) AS outlier_pct, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM d JOIN o ON d.j = o.j"""


def _described(long):
    named = ["mean", "median", "std", "mad", "min", "q1", "q3", "max", "iqr", "skew", "kurtosis"]
    return C.describe(long).select(column(), "n_unique", *[r6(F.col(c)).alias(c) for c in named], F.round("var", 4).alias("var"), "outliers", "outlier_pct")


@query("column_describe", f"WITH {VEC_RELU}{_DESCRIBE}")
def column_describe(spark, sf_dir):
    """The description of every coordinate of the vectors."""
    return _described(long_form(vec_relu(spark, sf_dir)))


@query("column_describe_orders", f"WITH {ORDER_VEC}{_DESCRIBE}")
def column_describe_orders(spark, sf_dir):
    """The same over the order vectors, the volume case."""
    return _described(long_form(order_vec(spark, sf_dir)))


@query("column_mode", f"""
WITH {ORDER_VEC}, c AS (SELECT j, v, count(*) AS n FROM l GROUP BY j, v), r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY n DESC, v) AS k FROM c)
SELECT CAST(j AS INTEGER) AS j, v AS mode, CAST(n AS BIGINT) AS frequency FROM r WHERE k = 1""")
def column_mode(spark, sf_dir):
    """The most frequent value of each column, the smallest of equals."""
    counts = long_form(order_vec(spark, sf_dir)).groupBy("j", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("j").agg(F.max_by(F.struct("v", "n"), F.struct(F.col("n"), -F.col("v"))).alias("b"))
    return best.select(column(), F.col("b.v").alias("mode"), F.col("b.n").alias("frequency"))


@query("column_range", f"WITH {VEC_RELU} SELECT CAST(j AS INTEGER) AS j, round(max(v) - min(v), 6) AS range FROM l GROUP BY j")
def column_range(spark, sf_dir):
    """Largest less smallest value of each column."""
    return long_form(vec_relu(spark, sf_dir)).groupBy("j").agg(r6(F.max("v") - F.min("v")).alias("range")).select(column(), "range")


@query("value_counts", f"WITH {VEC_PAIRS} SELECT CASE WHEN y = 1 THEN 'same' ELSE 'different' END AS target, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1")
def value_counts(spark, sf_dir):
    """Rows per mapped label of the pair vectors."""
    return vec_pairs(spark, sf_dir).groupBy(F.when(F.col("y") == 1, "same").otherwise("different").alias("target")).agg(F.count("*").alias("n"))


@query("class_means", f"""
WITH {VEC_RELU}
SELECT CAST(j AS INTEGER) AS j, round(avg(v) FILTER (y = 0), 6) AS mean0, round(avg(v) FILTER (y = 1), 6) AS mean1, round(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0), 6) + 0.0 AS gap FROM l GROUP BY j""")
def class_means(spark, sf_dir):
    """Mean vectors by class and their difference, in one pass."""
    of = lambda c: F.avg(F.when(F.col("y") == c, F.col("v")))
    return long_form(vec_relu(spark, sf_dir)).groupBy("j").agg(r6(of(0)).alias("mean0"), r6(of(1)).alias("mean1"), r6(of(1) - of(0)).alias("gap")).select(column(), "mean0", "mean1", "gap")


@query("group_multi_agg", f"""
WITH {ORDER_VEC} SELECT y, CAST(j AS INTEGER) AS j, round(avg(v), 6) AS mean, round(median(v), 6) AS median, CAST(count(*) FILTER (v > 1) AS BIGINT) AS n_gt_1, CAST(count(*) FILTER (v > 10) AS BIGINT) AS n_gt_10 FROM l GROUP BY y, j""")
def group_multi_agg(spark, sf_dir):
    """Several aggregates and conditional counts per class and column."""
    long = long_form(order_vec(spark, sf_dir))
    agg = long.groupBy("y", "j").agg(F.avg("v").alias("mean"), F.count_if(F.col("v") > 1).alias("n_gt_1"), F.count_if(F.col("v") > 10).alias("n_gt_10"))
    return agg.join(quantiles(long, [0.5], "y", "j"), ["y", "j"]).select("y", column(), r6(F.col("mean")).alias("mean"), r6(F.col("q")[0]).alias("median"), "n_gt_1", "n_gt_10")


@query("group_concat", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(spark, sf_dir):
    """Names of each group in order, joined."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("argmax_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def argmax_per_group(spark, sf_dir):
    """The row with the largest value of each group; ties to the smaller key."""
    best = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by(F.struct("c_custkey", "c_acctbal"), F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("b"))
    return best.select("c_mktsegment", "b.*")


@query("group_head20", "SELECT c_nationkey, c_custkey, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 20")
def group_head20(spark, sf_dir):
    """The first 20 rows of each group; Spark limits each group before the shuffle."""
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", k.alias("k")).where("k <= 20")


@query("duplicate_groups", f"""
WITH {DOC_VEC}, g AS (SELECT x, count(*) AS n, min(id) AS first_id, count(DISTINCT y) AS labels FROM v GROUP BY x)
SELECT CAST(count(*) FILTER (n > 1) AS BIGINT) AS groups, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS rows, CAST(count(*) FILTER (n > 1 AND labels <= 1) AS BIGINT) AS consistent, CAST(count(*) AS BIGINT) AS distinct_rows FROM g""")
def duplicate_groups(spark, sf_dir):
    """Groups of rows with equal vectors: number, largest, rows and those with one label."""
    g = doc_vec(spark, sf_dir).groupBy("x").agg(F.count("*").alias("n"), F.countDistinct("y").alias("labels"))
    return g.agg(F.count_if(F.col("n") > 1).alias("groups"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("rows"), F.count_if((F.col("n") > 1) & (F.col("labels") <= 1)).alias("consistent"), F.count("*").alias("distinct_rows"))


@query("distinct_inverse", f"""
WITH {DOC_VEC}, g AS (SELECT x, min(id) AS first_id, count(*) AS n FROM v GROUP BY x) SELECT v.id, g.first_id, CAST(g.n AS BIGINT) AS n FROM v JOIN g ON v.x = g.x""")
def distinct_inverse(spark, sf_dir):
    """The group of equal vectors of each row, named by its smallest id, and the group's size."""
    v = doc_vec(spark, sf_dir)
    return v.join(v.groupBy("x").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "x").select("id", "first_id", "n")


@query("zero_mask_groups", f"""
WITH {ORDER_VEC}, m AS (SELECT id, y, array_to_string(list_transform(x, lambda e: CASE WHEN e = 0 THEN '0' ELSE '1' END), '') AS mask FROM v)
SELECT mask, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) > 1 AS BOOLEAN) AS repeated FROM m GROUP BY mask""")
def zero_mask_groups(spark, sf_dir):
    """Rows per zero pattern."""
    m = order_vec(spark, sf_dir).select("y", V.mask(F.col("x")).alias("mask"))
    return m.groupBy("mask").agg(F.count("*").alias("n"), F.sum("y").alias("positive"), (F.count("*") > 1).alias("repeated"))


@query("positive_median_scale", f"""
WITH {ORDER_VEC} SELECT CAST(j AS INTEGER) AS j, round(CASE WHEN count(*) FILTER (v > 0) >= 5 AND median(v) FILTER (v > 0) > 1e-10 THEN median(v) FILTER (v > 0) ELSE 1 END, 6) AS scale FROM l GROUP BY j""")
def positive_median_scale(spark, sf_dir):
    """The robust scale of each column."""
    return C.positive_scale(long_form(order_vec(spark, sf_dir))).select(column(), r6(F.col("scale")).alias("scale"))


@query("robust_scale_log1p", f"""
WITH {ORDER_VEC}, s AS (SELECT j, CASE WHEN count(*) FILTER (v > 0) >= 5 AND median(v) FILTER (v > 0) > 1e-10 THEN median(v) FILTER (v > 0) ELSE 1 END AS scale FROM l GROUP BY j)
SELECT id, CAST(l.j AS INTEGER) AS j, round(ln(1 + v / scale), 6) AS z FROM l JOIN s ON l.j = s.j""")
def robust_scale_log1p(spark, sf_dir):
    """log(1 + value / robust scale); the scales are a row per column."""
    long = long_form(order_vec(spark, sf_dir))
    return long.join(F.broadcast(C.positive_scale(long)), "j").select("id", column(), r6(F.log1p(F.col("v") / F.col("scale"))).alias("z"))


@query("quantile_edges", f"""
WITH {ORDER_VEC}, e AS (SELECT DISTINCT j, round(e, 6) AS edge FROM (SELECT j, unnest(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) FILTER (v > 0)) AS e FROM l GROUP BY j))
SELECT CAST(j AS INTEGER) AS j, edge FROM e WHERE edge IS NOT NULL""")
def quantile_edges(spark, sf_dir):
    """Interior edges of eight bins over the positive values, without repeats."""
    return C.quantile_edges(long_form(order_vec(spark, sf_dir)), 8).select(column(), F.explode("edges").alias("edge")).select("j", r6(F.col("edge")).alias("edge")).distinct()


@query("target_corr", f"""
WITH {VEC_RELU}, r AS (SELECT j, v, y, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS rv FROM l)
SELECT CAST(j AS INTEGER) AS j, round(corr(v, y), 6) + 0.0 AS pearson, round(corr(rv, y), 6) + 0.0 AS spearman FROM r GROUP BY j""")
def target_corr(spark, sf_dir):
    """Pearson and Spearman correlation of each column with the label; ranks of a 0/1 label do not change it."""
    long = long_form(vec_relu(spark, sf_dir))
    ranked = long.join(average_rank_by_counts(long, "v", "j"), ["j", "v"])
    return ranked.groupBy("j").agg(r6(F.corr("v", F.col("y").cast("double"))).alias("pearson"), r6(F.corr("rank", F.col("y").cast("double"))).alias("spearman")).select(column(), "pearson", "spearman")


@query("pearson_pairs", f"""
WITH {VEC_RELU} SELECT CAST(a.j AS INTEGER) AS a, CAST(b.j AS INTEGER) AS b, round(corr(a.v, b.v), 6) + 0.0 AS r, round(covar_samp(a.v, b.v), 6) + 0.0 AS covariance FROM l a JOIN l b ON a.id = b.id AND a.j < b.j GROUP BY a.j, b.j""")
def pearson_pairs(spark, sf_dir):
    """Correlation and sample covariance of all pairs of columns."""
    long = long_form(vec_relu(spark, sf_dir))
    s = F.broadcast(long.groupBy("j").agg(F.stddev_pop("v").alias("s"), F.count("*").alias("m")))  # a row per column
    r = C.correlations(long).join(s.select(F.col("j").alias("a"), F.col("s").alias("sa"), "m"), "a").join(s.select(F.col("j").alias("b"), F.col("s").alias("sb")), "b")
    return r.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), r6(F.col("r")).alias("r"), r6(F.col("r") * F.col("sa") * F.col("sb") * F.col("m") / (F.col("m") - 1)).alias("covariance"))


@query("spearman_pairs_high", f"""
WITH {VEC_RELU}, r AS (SELECT id, j, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS v FROM l),
c AS (SELECT a.j AS a, b.j AS b, corr(a.v, b.v) AS r FROM r a JOIN r b ON a.id = b.id AND a.j < b.j GROUP BY a.j, b.j)
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(r, 6) AS r FROM c WHERE abs(r) >= 0.1""")
def spearman_pairs_high(spark, sf_dir):
    """Pairs of columns with a rank correlation of at least 0.1 in size."""
    r = C.correlations(long_form(vec_relu(spark, sf_dir)), spearman=True).where(F.abs("r") >= 0.1)
    return r.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), r6(F.col("r")).alias("r"))


@query("feature_descriptors", f"""
WITH {ORDER_VEC}
SELECT CAST(j AS INTEGER) AS j, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.9), 6) AS q90, round(quantile_cont(v, 0.95), 6) AS q95 FROM l GROUP BY j""")
def feature_descriptors(spark, sf_dir):
    """Mean, deviation, share of zeros and six quantiles per column."""
    long, p = long_form(order_vec(spark, sf_dir)), [5, 25, 50, 75, 90, 95]
    m = long.groupBy("j").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.avg((F.col("v") == 0).cast("double"))).alias("zero_share"))
    return m.join(quantiles(long, [k / 100 for k in p], "j"), "j").select(column(), "mean", "std", "zero_share", *[r6(F.col("q")[i]).alias(f"q{k:02d}") for i, k in enumerate(p)])


@query("hist_by_class", f"""
WITH {VEC_RELU}, t AS (SELECT y, sum(v) AS total FROM l GROUP BY id, y), m AS (SELECT min(total) AS lo, max(total) AS hi FROM t)
SELECT y, CAST(least(49, floor((total - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM t, m GROUP BY 1, 2""")
def hist_by_class(spark, sf_dir):
    """Rows per class in 50 equal bins of the row total."""
    t = vec_relu(spark, sf_dir).select("y", V.total(F.col("x")).alias("total"))
    m = F.broadcast(t.agg(F.min("total").alias("lo"), F.max("total").alias("hi")))  # one row
    return t.join(m).groupBy("y", F.least(F.lit(49), F.floor((F.col("total") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("column_top_k", f"""
WITH {VEC_RELU}, g AS (SELECT j, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS gap FROM l GROUP BY j)
SELECT CAST(j AS INTEGER) AS j, round(gap, 6) AS gap FROM g ORDER BY abs(gap) DESC, j LIMIT 10""")
def column_top_k(spark, sf_dir):
    """The ten columns with the largest class gap in size."""
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    return long_form(vec_relu(spark, sf_dir)).groupBy("j").agg(gap.alias("gap")).orderBy(F.abs("gap").desc(), "j").limit(10).select(column(), r6(F.col("gap")).alias("gap"))
