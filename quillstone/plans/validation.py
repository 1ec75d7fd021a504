"""Contracts of inputs and outputs, joins that must be one to one, set operations on ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import folds
from ..sources import files
from ..sources.fixtures import DOC_VEC, ORDER_VEC, VEC_RELU, doc_vec, order_vec, table, vec_relu
from .register import query


@query("quality_report", f"""
WITH {DOC_VEC}, r AS (SELECT * FROM v)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT id) AS BIGINT) AS distinct_ids, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infinite, CAST(sum(len(list_filter(x, lambda e: e < 0))) AS BIGINT) AS negative,
  CAST(count(*) FILTER (y NOT IN (0, 1)) AS BIGINT) AS odd_labels, CAST(min(len(x)) AS BIGINT) AS width_min, CAST(max(len(x)) AS BIGINT) AS width_max FROM r""")
def quality_report(spark, sf_dir):
    """Everything that a table of vectors is checked for."""
    return files.quality_report(doc_vec(spark, sf_dir))


@query("submission_left_join", f"""
WITH {ORDER_VEC}, s AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey IN (SELECT id FROM v))
SELECT s.id, s.pos, round(1 / (1 + exp(-(v.x[1] - 4))), 6) AS score FROM s LEFT JOIN v ON s.id = v.id""")
def submission_left_join(spark, sf_dir):
    """The sample's ids in order, each with its score, checked to be one to one and in [0, 1]."""
    from ..operators.ranks import global_rank

    v = order_vec(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(v.select("id"), "id", "left_semi")
    sample = global_rank(ids, "id", "pos").select("id", (F.col("pos") + 1).alias("pos"))
    scores = v.select("id", V.sigmoid(F.col("x")[0] - 4).alias("score"))
    return files.submission(sample, scores).select("id", "pos", r6(F.col("score")).alias("score"))


@query("run_log_flatten", """
SELECT CAST(o_custkey % 7 AS VARCHAR) AS started, o_orderpriority AS model, round(o_totalprice / 1000000, 6) AS cv, CAST(o_orderkey AS BIGINT) AS key FROM orders""")
def run_log_flatten(spark, sf_dir):
    """JSON logs with nested results, written by to_json and flattened again."""
    o = table(spark, sf_dir, "orders")
    entry = F.struct(F.col("o_orderpriority").alias("model"), r6(F.col("o_totalprice") / 1000000).alias("cv"), F.col("o_orderkey").cast("double").alias("seconds"))
    logs = o.groupBy((F.col("o_custkey") % 7).cast("string").alias("started"), F.floor(F.col("o_orderkey") / 64).alias("log")).agg(F.collect_list(entry).alias("results"))  # 64 results a log
    flat = files.flatten_run_log(logs.select(F.to_json(F.struct("started", "results")).alias("json")))
    return flat.select("started", "model", "cv", F.col("seconds").cast("long").alias("key"))


@query("adversarial_union", f"""
WITH {VEC_RELU}, u AS (SELECT x, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS is_test FROM v)
SELECT is_test, CAST(count(*) AS BIGINT) AS n, round(avg(list_sum(x)), 6) AS mean_total FROM u GROUP BY is_test""")
def adversarial_union(spark, sf_dir):
    """Train and test rows in one table with a source flag."""
    v = vec_relu(spark, sf_dir)
    test = v.where("id % 4 = 0").withColumn("is_test", F.lit(1))
    train = v.where("id % 4 <> 0").withColumn("is_test", F.lit(0))
    return train.unionByName(test).groupBy("is_test").agg(F.count("*").alias("n"), r6(F.avg(V.total(F.col("x")))).alias("mean_total"))


@query("split_set_checks", f"""
WITH {ORDER_VEC}, s AS (SELECT id, (row_number() OVER (PARTITION BY y ORDER BY md5('5:' || id), id) - 1) % 20 < 3 AS h FROM v)
SELECT CAST(0 AS BIGINT) AS in_both, CAST((SELECT count(*) FROM v) - (SELECT count(*) FROM s) AS BIGINT) AS missing, CAST((SELECT count(DISTINCT o_custkey) FROM orders JOIN s ON o_orderkey = id WHERE h) AS BIGINT) AS covered""")
def split_set_checks(spark, sf_dir):
    """Training and held-out ids share nothing and miss nothing; customers that the held-out rows cover."""
    v = order_vec(spark, sf_dir)
    split = folds.stratified(v, 20, [5])
    train, held = split.where("fold >= 3").select("id"), split.where("fold < 3").select("id")
    both = train.intersect(held).agg(F.count("*").alias("in_both"))
    missing = v.select("id").exceptAll(train.unionByName(held)).agg(F.count("*").alias("missing"))
    covered = table(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("id"), "left_semi").agg(F.countDistinct("o_custkey").alias("covered"))
    return both.join(missing).join(covered)  # one row each


@query("ids_symmetric_difference", "SELECT doc_id, side FROM (SELECT doc_id, 'documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def ids_symmetric_difference(spark, sf_dir):
    """Ids that only one of two tables has."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").withColumn("side", F.lit("documents")).unionByName(l.join(d, "doc_id", "left_anti").withColumn("side", F.lit("labels")))


@query("fold_alignment", f"""
WITH {VEC_RELU}, a AS (SELECT id, (row_number() OVER (PARTITION BY y ORDER BY md5('11:' || id), id) - 1) % 5 AS fold FROM v), b AS (SELECT id, (row_number() OVER (PARTITION BY y ORDER BY md5('12:' || id), id) - 1) % 5 AS fold FROM v)
SELECT CAST(count(*) FILTER (a.fold <> b.fold) AS BIGINT) AS moved, CAST(count(*) AS BIGINT) AS n FROM a JOIN b ON a.id = b.id""")
def fold_alignment(spark, sf_dir):
    """Rows that two fold tables place differently: zero for the same seed."""
    v = vec_relu(spark, sf_dir)
    a, b = folds.stratified(v, 5, [11]).select("id", "fold"), folds.stratified(v, 5, [12]).select("id", F.col("fold").alias("fold2"))
    return a.join(b, "id", "full_outer").agg(F.count_if(~F.col("fold").eqNullSafe(F.col("fold2"))).alias("moved"), F.count("*").alias("n"))


@query("ordered_report", "SELECT n.n_name AS name, r.r_name AS region, CAST(row_number() OVER (ORDER BY o.k, n.n_name) AS INTEGER) AS k FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN (SELECT unnest(['EUROPE', 'ASIA', 'AFRICA', 'AMERICA', 'MIDDLE EAST']) AS r_name, unnest([1, 2, 3, 4, 5]) AS k) o ON o.r_name = r.r_name")
def ordered_report(spark, sf_dir):
    """Rows in the order of an explicit list of groups, joined to names: a report of a few rows."""
    from pyspark.sql import Window

    order = F.create_map(*[F.lit(x) for i, n in enumerate(("EUROPE", "ASIA", "AFRICA", "AMERICA", "MIDDLE EAST")) for x in (n, i)])
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("o", F.try_element_at(order, F.col("r_name"))).where("o IS NOT NULL")
    return n.select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.row_number().over(Window.orderBy("o", "n_name")).alias("k"))


@query("column_stack", f"WITH {VEC_RELU} SELECT id, CAST(len(x) * 2 + 3 AS INTEGER) AS width, round(list_sum(x) + list_sum(list_transform(x, lambda e: ln(1 + e))), 6) AS total FROM v")
def column_stack(spark, sf_dir):
    """Blocks of columns side by side in one array: values, logarithms and three aggregates."""
    x = F.col("x")
    wide = F.concat(x, V.log1p(x), F.array(V.total(x), F.array_max(x), F.array_min(x)))
    rows = vec_relu(spark, sf_dir).select("id", wide.alias("w"))
    return rows.select("id", F.size("w").alias("width"), r6(V.total(F.slice("w", 1, 128))).alias("total"))


@query("name_prefixes", "SELECT p_partkey, starts_with(p_name, 'p') AS has_prefix, regexp_matches(p_type, '^(STANDARD|SMALL)') AS in_family, regexp_replace(p_brand, 'Brand', '') AS short FROM part")
def name_prefixes(spark, sf_dir):
    """Prefix tests and prefix removal on names."""
    return table(spark, sf_dir, "part").select("p_partkey", F.startswith("p_name", F.lit("p")).alias("has_prefix"), F.rlike("p_type", F.lit("^(STANDARD|SMALL)")).alias("in_family"), F.regexp_replace("p_brand", "Brand", "").alias("short"))
