"""Labelled vectors (id, x, y) derived from the driver's tables, with the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import r6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vec_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings without their negative parts; y: label below 5."""
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    return e.select(F.col("vec_id").alias("id"), x.alias("x"), (F.col("label") < 5).cast("int").alias("y"))


VEC_RELU = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: greatest(CAST(e AS DOUBLE), 0.0::DOUBLE)) AS x, CAST(label < 5 AS INTEGER) AS y FROM embeddings),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next in vec_id order: absolute differences; y: equal labels.

    The order comes from a dense rank over ids, joined with itself; ids are small rows.
    """
    from ..operators.ranks import global_rank

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    ranked = global_rank(e, "vec_id", "k")
    n = ranked.agg(F.count("*").alias("n"))
    nxt = ranked.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("label").alias("label2"))
    joined = ranked.join(F.broadcast(n)).join(nxt, F.col("k2") == (F.col("k") + 1) % F.col("n"))
    x = F.zip_with("x", "x2", lambda a, b: F.abs(a - b))
    return joined.select(F.col("vec_id").alias("id"), x.alias("x"), (F.col("label") == F.col("label2")).cast("int").alias("y"))


VEC_PAIRS = """
ranked AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, label, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings),
v AS (SELECT a.vec_id AS id, list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])) AS x, CAST(a.label = b.label AS INTEGER) AS y FROM ranked a JOIN ranked b ON b.k = (a.k + 1) % a.n),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""


def order_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight numbers per order; y: the priority starts with 1 or 2."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    agg = line.groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("a"), F.countDistinct("l_partkey").cast("double").alias("b"), r6(F.sum("l_quantity")).alias("c"), r6(F.max("l_extendedprice")).alias("d"),
        r6(F.min("l_extendedprice")).alias("e"), F.max("l_discount").alias("f"), F.max("l_tax").alias("g"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("h"),
    )
    y = F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("int")
    return agg.join(orders, agg.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("id"), F.array(*"abcdefgh").alias("x"), y.alias("y"))


ORDER_VEC = """
agg AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS a, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS b, round(sum(l_quantity), 6) AS c, round(max(l_extendedprice), 6) AS d,
    round(min(l_extendedprice), 6) AS e, max(l_discount) AS f, max(l_tax) AS g, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS h
  FROM lineitem GROUP BY l_orderkey),
v AS (SELECT l_orderkey AS id, [a, b, c, d, e, f, g, h] AS x, CAST(substr(o_orderpriority, 1, 1) IN ('1', '2') AS INTEGER) AS y FROM agg JOIN orders ON l_orderkey = o_orderkey),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""


def part_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same eight numbers per part that order_vec has per order, without a label: rows for fitted models to score."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    agg = line.groupBy("l_partkey").agg(
        F.count("*").cast("double").alias("a"), F.countDistinct("l_orderkey").cast("double").alias("b"), r6(F.sum("l_quantity")).alias("c"), r6(F.max("l_extendedprice")).alias("d"),
        r6(F.min("l_extendedprice")).alias("e"), F.max("l_discount").alias("f"), F.max("l_tax").alias("g"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("h"),
    )
    return agg.join(part, agg.l_partkey == part.p_partkey).select(F.col("l_partkey").alias("id"), F.array(*"abcdefgh").alias("x"))


PART_VEC = """
pagg AS (
  SELECT l_partkey, CAST(count(*) AS DOUBLE) AS a, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS b, round(sum(l_quantity), 6) AS c, round(max(l_extendedprice), 6) AS d,
    round(min(l_extendedprice), 6) AS e, max(l_discount) AS f, max(l_tax) AS g, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS h
  FROM lineitem GROUP BY l_partkey),
pv AS (SELECT l_partkey AS id, [a, b, c, d, e, f, g, h] AS x FROM pagg JOIN part ON l_partkey = p_partkey)"""


def doc_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of characters, blanks, digits, punctuation and newlines; y: the quality label, if any."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    x = F.array(F.length("text").cast("double"), count(" "), count("[0-9]"), count("[.,;:!?]"), count("\n"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), x.alias("x"), F.col("quality").cast("int").alias("y"))


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS DOUBLE)"


DOC_VEC = f"""
v AS (SELECT d.doc_id AS id, [CAST(length(text) AS DOUBLE), {_count(' ')}, {_count('[0-9]')}, {_count('[.,;:!?]')}, {_count(chr(92) + 'n')}] AS x, CAST(quality AS INTEGER) AS y FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""


def long_form(vec: DataFrame) -> DataFrame:
    """(id, y, j, v): one row per coordinate, the layout of all column statistics."""
    return vec.select("id", "y", F.posexplode("x").alias("j", "v"))
