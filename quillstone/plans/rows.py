"""Row functions over vectors: aggregates in four variants, transforms, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..sources.fixtures import ORDER_VEC, VEC_RELU, long_form, order_vec, vec_relu
from .register import query

@query("row_aggregates_v1", f"""
WITH {VEC_RELU}
SELECT id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(var_samp(v), 6) AS var, round(mad(v), 6) AS mad, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(sum(v), 6) AS total
FROM l GROUP BY id""")
def row_aggregates_v1(spark, sf_dir):
    """Thirteen aggregates of each row with the sample deviation."""
    s = F.sort_array(F.col("x"))
    q = lambda p: V.quantile(s, p)
    named = {"mean": V.mean(F.col("x")), "median": q(0.5), "std": F.sqrt(V.variance(F.col("x"), 1)), "var": V.variance(F.col("x"), 1), "mad": V.median_deviation(F.col("x")), "min": F.array_min(F.col("x")), "q1": q(0.25), "q2": q(0.5), "q3": q(0.75), "max": F.array_max(F.col("x")), "iqr": q(0.75) - q(0.25), "total": V.total(F.col("x"))}
    return vec_relu(spark, sf_dir).select("id", *[r6(c).alias(n) for n, c in named.items()])


@query("row_aggregates_v2", f"""
WITH {ORDER_VEC}
SELECT id, round(sum(v), 6) AS total, CAST(count(*) FILTER (v = 0) AS BIGINT) AS count_zeros, round(stddev_samp(v) / nullif(avg(v), 0), 6) AS relative_std, round(max(v) / nullif(sum(v), 0), 6) AS max_share,
  round(quantile_cont(v, 0.9) / nullif(median(v), 0), 6) AS q90_median_ratio, round(max(v), 6) AS max, round(sum(ln(1 + v)), 6) AS log1p_sum
FROM l GROUP BY id""")
def row_aggregates_v2(spark, sf_dir):
    """Seven aggregates with the sample deviation; a zero denominator gives null."""
    s = F.sort_array(F.col("x"))
    return order_vec(spark, sf_dir).select(
        "id", r6(V.total(F.col("x"))).alias("total"), V.zeros(F.col("x")).alias("count_zeros"), r6(F.try_divide(F.sqrt(V.variance(F.col("x"), 1)), V.mean(F.col("x")))).alias("relative_std"), r6(F.try_divide(F.array_max(F.col("x")), V.total(F.col("x")))).alias("max_share"),
        r6(F.try_divide(V.quantile(s, 0.9), V.quantile(s, 0.5))).alias("q90_median_ratio"), r6(F.array_max(F.col("x"))).alias("max"), r6(V.total(V.log1p(F.col("x")))).alias("log1p_sum"),
    )


@query("row_aggregates_v3", f"""
WITH {VEC_RELU}
SELECT id, round(sum(v), 6) AS total, CAST(count(*) FILTER (v = 0) AS BIGINT) AS count_zeros, round(stddev_pop(v) / greatest(abs(avg(v)), 1e-10), 6) AS relative_std, round(max(v) / greatest(abs(sum(v)), 1e-10), 6) AS max_share,
  round(max(v), 6) AS max, round(sum(ln(1 + greatest(v, 0))), 6) AS log1p_sum
FROM l GROUP BY id""")
def row_aggregates_v3(spark, sf_dir):
    """Six aggregates with the population deviation; denominators are at least EPS."""
    floor = lambda c: F.greatest(F.abs(c), F.lit(V.EPS))
    clipped = F.transform(F.col("x"), lambda v: F.log1p(F.greatest(v, F.lit(0.0))))
    return vec_relu(spark, sf_dir).select(
        "id", r6(V.total(F.col("x"))).alias("total"), V.zeros(F.col("x")).alias("count_zeros"), r6(F.sqrt(V.variance(F.col("x"), 0)) / floor(V.mean(F.col("x")))).alias("relative_std"), r6(F.array_max(F.col("x")) / floor(V.total(F.col("x")))).alias("max_share"), r6(F.array_max(F.col("x"))).alias("max"), r6(V.total(clipped)).alias("log1p_sum"),
    )


@query("row_aggregates_v4", f"""
WITH {ORDER_VEC}
SELECT id, round(sum(v), 6) AS total, CAST(count(*) FILTER (v = 0) AS BIGINT) AS count_zeros, round(coalesce(stddev_pop(v) / nullif(avg(v), 0), 0), 6) AS relative_std, round(coalesce(max(v) / nullif(sum(v), 0), 0), 6) AS max_share,
  round(coalesce(quantile_cont(v, 0.9) / nullif(median(v), 0), 0), 6) AS q90_median_ratio
FROM l GROUP BY id""")
def row_aggregates_v4(spark, sf_dir):
    """Five aggregates with the population deviation; a zero denominator gives zero."""
    s, zero = F.sort_array(F.col("x")), F.lit(0.0)
    return order_vec(spark, sf_dir).select(
        "id", r6(V.total(F.col("x"))).alias("total"), V.zeros(F.col("x")).alias("count_zeros"), r6(F.coalesce(F.try_divide(F.sqrt(V.variance(F.col("x"), 0)), V.mean(F.col("x"))), zero)).alias("relative_std"),
        r6(F.coalesce(F.try_divide(F.array_max(F.col("x")), V.total(F.col("x"))), zero)).alias("max_share"), r6(F.coalesce(F.try_divide(V.quantile(s, 0.9), V.quantile(s, 0.5)), zero)).alias("q90_median_ratio"),
    )


@query("row_thresholds", f"""
WITH {VEC_RELU}
SELECT id, CAST(count(*) FILTER (v <= 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (v < 0.5) AS BIGINT) AS n_05, CAST(count(*) FILTER (ln(1 + v) < 0.1) AS BIGINT) AS n_log_01, CAST(count(*) FILTER (ln(1 + v) < 0.2) AS BIGINT) AS n_log_02,
  round(quantile_cont(v, 0.95), 6) AS q95, round(sum(abs(ln(1 + v))), 6) AS log_l1
FROM l GROUP BY id""")
def row_thresholds(spark, sf_dir):
    """Counts of values below thresholds, raw and logarithmic, the 95% quantile and the log norm."""
    g = V.log1p(F.col("x"))
    return vec_relu(spark, sf_dir).select("id", F.size(F.filter("x", lambda v: v <= 0)).cast("long").alias("n_zero"), V.count_below(F.col("x"), 0.5).alias("n_05"), V.count_below(g, 0.1).alias("n_log_01"), V.count_below(g, 0.2).alias("n_log_02"), r6(V.quantile(F.sort_array(F.col("x")), 0.95)).alias("q95"), r6(V.norm(g, 1)).alias("log_l1"))


@query("row_energy", f"""
WITH {VEC_RELU}, s AS (SELECT id, v / nullif(sum(v) OVER (PARTITION BY id), 0) AS p, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS k FROM l)
SELECT id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, round(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 6) AS effective, round(sum(p * p), 6) AS energy, round(sum(p) FILTER (k <= 8), 6) AS top8
FROM s GROUP BY id""")
def row_energy(spark, sf_dir):
    """Entropy, its exponential, sum of squares and the top mass of each row as a distribution."""
    p = F.transform("x", lambda v: F.coalesce(F.try_divide(v, F.col("sum")), F.lit(0.0)))
    rows = vec_relu(spark, sf_dir).withColumn("sum", V.total(F.col("x"))).select("id", p.alias("p"))
    entropy = -V.total(F.transform("p", lambda v: F.when(v > 0, v * F.ln(v)).otherwise(0.0)))
    return rows.select("id", r6(entropy).alias("entropy"), r6(F.exp(entropy)).alias("effective"), r6(V.dot(F.col("p"), F.col("p"))).alias("energy"), r6(V.total(F.slice(F.sort_array("p", asc=False), 1, 8))).alias("top8"))


@query("normalize_l1_l2", f"""
WITH {VEC_RELU}, n AS (SELECT *, sum(abs(v)) OVER (PARTITION BY id) AS n1, sqrt(sum(v * v) OVER (PARTITION BY id)) AS n2 FROM l)
SELECT id, CAST(j AS INTEGER) AS j, round(coalesce(v / nullif(n1, 0), 0), 6) AS composition, round(coalesce(v / nullif(n2, 0), 0), 6) AS direction, round(ln(1 + n1), 6) AS log_n1, round(ln(1 + n2), 6) AS log_n2 FROM n""")
def normalize_l1_l2(spark, sf_dir):
    """Each row over its L1 and L2 norm, with the logarithms of the norms."""
    rows = vec_relu(spark, sf_dir).withColumn("n1", V.norm(F.col("x"), 1)).withColumn("n2", V.norm(F.col("x"), 2))
    rows = rows.select("id", "n1", "n2", F.posexplode(F.arrays_zip(V.scaled(F.col("x"), F.col("n1")).alias("a"), V.scaled(F.col("x"), F.col("n2")).alias("b"))).alias("j", "p"))
    return rows.select("id", "j", r6(F.col("p.a")).alias("composition"), r6(F.col("p.b")).alias("direction"), r6(F.log1p("n1")).alias("log_n1"), r6(F.log1p("n2")).alias("log_n2"))


@query("row_sorted_shape", f"""
WITH {VEC_RELU}, s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS k, v, avg(v) OVER (PARTITION BY id) AS m, median(v) OVER (PARTITION BY id) AS d FROM l)
SELECT id, CAST(k AS INTEGER) AS k, round(v, 6) AS sorted, round(v - m, 6) + 0.0 AS by_mean, round(v - d, 6) + 0.0 AS by_median FROM s""")
def row_sorted_shape(spark, sf_dir):
    """The sorted row, and the same less its mean and less its median."""
    rows = vec_relu(spark, sf_dir).select("id", F.sort_array("x").alias("s"), V.mean(F.col("x")).alias("m"), V.median(F.col("x")).alias("d"))
    return rows.select("id", "m", "d", F.posexplode("s").alias("k", "v")).select("id", "k", r6(F.col("v")).alias("sorted"), r6(F.col("v") - F.col("m")).alias("by_mean"), r6(F.col("v") - F.col("d")).alias("by_median"))


def _blocks(n: int) -> str:
    return f"list_concat({', '.join(f'list_sort(x[{64 * b // n + 1}:{64 * (b + 1) // n}])' for b in range(n))})"


@query("block_sort", f"""
WITH {VEC_RELU}, s AS (SELECT id, {_blocks(2)} AS a, {_blocks(4)} AS b, {_blocks(8)} AS c FROM v)
SELECT id, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS k, unnest(a) AS by2, unnest(b) AS by4, unnest(c) AS by8 FROM s""")
def block_sort(spark, sf_dir):
    """Rows with 2, 4 and 8 equal blocks sorted each."""
    zipped = F.arrays_zip(*[V.block_sort(F.col("x"), n).alias(f"by{n}") for n in (2, 4, 8)])
    return vec_relu(spark, sf_dir).select("id", F.posexplode(zipped).alias("k", "p")).select("id", "k", "p.by2", "p.by4", "p.by8")


@query("grouped_sort", f"""
WITH {VEC_RELU}
SELECT id, CAST(j % 4 AS INTEGER) AS grp, CAST(row_number() OVER (PARTITION BY id, j % 4 ORDER BY v) - 1 AS INTEGER) AS k, v FROM l""")
def grouped_sort(spark, sf_dir):
    """Each row's values sorted inside groups of columns (here the place modulo four)."""
    pick = lambda g: F.sort_array(F.transform(F.sequence(F.lit(g), F.size("x") - 1, F.lit(4)), lambda j: F.get("x", j)))
    rows = vec_relu(spark, sf_dir).select("id", F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), pick(g).alias("s")) for g in range(4)])).alias("g"))
    return rows.select("id", "g.grp", F.posexplode("g.s").alias("k", "v"))


@query("swap_halves_union", f"""
WITH {VEC_RELU}, u AS (SELECT id, y, 0 AS swapped, x FROM v UNION ALL SELECT id, y, 1, list_concat(x[33:64], x[1:32]) FROM v)
SELECT id, y, CAST(swapped AS INTEGER) AS swapped, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS j, unnest(x) AS v FROM u""")
def swap_halves_union(spark, sf_dir):
    """All rows and once more with their halves swapped."""
    rows = vec_relu(spark, sf_dir)
    both = rows.select("id", "y", F.lit(0).alias("swapped"), "x").unionByName(rows.select("id", "y", F.lit(1).alias("swapped"), V.swap_halves(F.col("x")).alias("x")))
    return both.select("id", "y", "swapped", F.posexplode("x").alias("j", "v"))


@query("row_permutation", f"""
WITH {VEC_RELU}
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY md5('7:' || id || ':' || j), j) - 1 AS INTEGER) AS k, v FROM l""")
def row_permutation(spark, sf_dir):
    """Each row's values in an order given by a hash: the permutation diagnostic."""
    keyed = F.transform("x", lambda v, j: F.struct(F.md5(F.concat_ws(":", F.lit("7"), F.col("id"), j)).alias("h"), j.alias("j"), v.alias("v")))
    return vec_relu(spark, sf_dir).select("id", F.posexplode(F.array_sort(keyed)).alias("k", "p")).select("id", "k", "p.v")


@query("column_shuffle", f"""
WITH {VEC_RELU}, a AS (SELECT j, id, v, row_number() OVER (PARTITION BY j ORDER BY id) AS k FROM l), b AS (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY md5('3:' || id || ':' || j), id) AS k FROM l)
SELECT a.id, CAST(a.j AS INTEGER) AS j, a.v, b.v AS shuffled FROM a JOIN b ON a.j = b.j AND a.k = b.k""")
def column_shuffle(spark, sf_dir):
    """Each column's values dealt to other rows: the null of the triangle test."""
    from pyspark.sql import Window

    cells = long_form(vec_relu(spark, sf_dir)).select("j", "id", "v")
    order = F.md5(F.concat_ws(":", F.lit("3"), "id", "j"))
    a = cells.withColumn("k", F.row_number().over(Window.partitionBy("j").orderBy("id")))
    b = cells.select("j", F.col("v").alias("shuffled"), F.row_number().over(Window.partitionBy("j").orderBy(order, "id")).alias("k"))
    return a.join(b, ["j", "k"]).select("id", "j", "v", "shuffled")


@query("scalar_functions", f"""
WITH {VEC_RELU}
SELECT id, CAST(j AS INTEGER) AS j, round(ln(1 + v), 6) AS log1p, round(sqrt(v), 6) AS root, round(pow(v, 0.7), 6) AS power, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(v + ln(1 + exp(-v)), 6) AS softplus,
  round(exp(v - max(v) OVER (PARTITION BY id)) / sum(exp(v)) OVER (PARTITION BY id) * exp(max(v) OVER (PARTITION BY id)), 6) AS softmax, round(least(greatest(v, 0.05), 0.2), 6) AS clipped FROM l""")
def scalar_functions(spark, sf_dir):
    """Logarithm, root, power, sigmoid, softplus, softmax and clip of every value."""
    top = F.array_max("x")
    rows = vec_relu(spark, sf_dir).withColumn("top", top).withColumn("sum", V.total(F.transform("x", lambda v: F.exp(v - F.col("top")))))
    v = F.col("v")
    named = {"log1p": F.log1p(v), "root": F.sqrt(v), "power": F.pow(v, F.lit(0.7)), "sigmoid": V.sigmoid(v), "softplus": V.softplus(v), "softmax": F.exp(v - F.col("top")) / F.col("sum"), "clipped": F.least(F.greatest(v, F.lit(0.05)), F.lit(0.2))}
    return rows.select("id", "top", "sum", F.posexplode("x").alias("j", "v")).select("id", "j", *[r6(c).alias(n) for n, c in named.items()])


@query("weighted_columns", f"""
WITH {VEC_RELU}
SELECT id, round(sum(v * CASE WHEN j < 32 THEN 50 ELSE 2 END), 6) AS weighted, round(sum(v * CASE WHEN j < 32 THEN 50 ELSE 2 END) FILTER (j % 2 = 0), 6) AS weighted_even FROM l GROUP BY id""")
def weighted_columns(spark, sf_dir):
    """Rows times a weight vector, and a subset of its columns by index."""
    weighted = F.transform("x", lambda v, j: v * F.when(j < 32, F.lit(50.0)).otherwise(F.lit(2.0)))
    rows = vec_relu(spark, sf_dir).select("id", weighted.alias("w"))
    return rows.select("id", r6(V.total(F.col("w"))).alias("weighted"), r6(V.total(F.filter("w", lambda v, j: j % 2 == 0))).alias("weighted_even"))


@query("grid_means", f"""
WITH {VEC_RELU}
SELECT CAST(j // 16 AS INTEGER) AS row, CAST(j % 16 AS INTEGER) AS col, round(avg(v), 6) AS mean, round(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0), 6) + 0.0 AS class_gap FROM l GROUP BY 1, 2""")
def grid_means(spark, sf_dir):
    """The columns as a grid of 16 per row: means and differences of class means, the data of the heat maps."""
    cells = long_form(vec_relu(spark, sf_dir))
    at = [F.floor(F.col("j") / 16).cast("int").alias("row"), (F.col("j") % 16).cast("int").alias("col")]
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    return cells.groupBy(*at).agg(r6(F.avg("v")).alias("mean"), r6(gap).alias("class_gap"))


@query("row_key_hash", f"""
WITH {VEC_RELU}
SELECT id, sha256('v1|' || id || '|' || y) AS key, 'f_' || lpad(CAST(id AS VARCHAR), 6, '0') AS name, regexp_replace('raw_' || id, '^raw_', '') AS plain FROM v""")
def row_key_hash(spark, sf_dir):
    """Content keys and padded names, as the caches use them."""
    return vec_relu(spark, sf_dir).select("id", F.sha2(F.concat_ws("|", F.lit("v1"), "id", "y"), 256).alias("key"), F.concat(F.lit("f_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.regexp_replace(F.concat(F.lit("raw_"), "id"), "^raw_", "").alias("plain"))
