"""Fit on one table, score another: builders whose states are written, read back and applied to rows that they have not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import estimators as E
from ..operators import folds
from ..operators.graph import scratch_root
from ..sources.fixtures import ORDER_VEC, PART_VEC, order_vec, part_vec
from ..sources.models import ModelStore
from .coordinates import ALPHA, AUC_SQL, BINS, FOLDS, ISO_SQL, SEED, TRAIN_SQL, _llr_sql
from .register import query


def training_rows(spark, sf_dir):
    """Order vectors with their labels and folds, logarithms taken."""
    vec = order_vec(spark, sf_dir)
    fold = folds.stratified(vec, FOLDS, [SEED]).select("id", "fold")
    return vec.join(fold, "id").select("id", "y", "fold", V.log1p(F.col("x")).alias("x"))


def external_rows(spark, sf_dir):
    return part_vec(spark, sf_dir).select("id", V.log1p(F.col("x")).alias("x"))


def fitted(spark, sf_dir, name: str, outward: bool = False) -> E.Builder:
    """The builder with the states as a later session finds them: saved under a version and loaded; outward: to score other tables only."""
    made = E.config(name, FOLDS, BINS, ALPHA).fit(training_rows(spark, sf_dir), outward)
    store = ModelStore(spark, f"{scratch_root(spark)}/models")
    version = store.save(name, made.states, {"folds": FOLDS, "bins": BINS, "alpha": ALPHA})
    return E.Builder(made.steps, made.folds, store.load(name, version), outward)


#: Logarithms in place of the values; the models see all rows (-1) or those of the other folds.
_LOG_SQL = f"""{ORDER_VEC.replace("v AS (", "raw AS (", 1).rsplit("l AS (", 1)[0]}
v AS (SELECT id, list_transform(x, lambda e: ln(1 + e)) AS x, y FROM raw),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""
_STATES_SQL = f"""{TRAIN_SQL},{_llr_sql()},{AUC_SQL},{ISO_SQL},
mu AS (SELECT model, j, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM t GROUP BY model, j),
st2 AS (SELECT st.*, count(*) OVER (PARTITION BY model) AS p FROM st)"""


def _features_sql(rows: str) -> str:
    """Features of the rows (id, model, j, v)."""
    return f"""
agg_f AS (SELECT id, sum(v) AS total, count(*) FILTER (v = 0) AS zeros, stddev_pop(v) / greatest(abs(avg(v)), 1e-10) AS relative_std, max(v) / greatest(abs(sum(v)), 1e-10) AS max_share FROM {rows} GROUP BY id),
geo AS (
  SELECT id, sqrt(sum((v - m0) * (v - m0))) - sqrt(sum((v - m1) * (v - m1))) AS d_euclid_diff, sum(v * (m1 - m0)) AS proj_w, sqrt(sum(v * v)) AS size, sqrt(sum((m1 - m0) * (m1 - m0))) AS wide,
    sum((v - (m0 + m1) / 2) * (m1 - m0)) AS dot, sum((v - (m0 + m1) / 2) * (v - (m0 + m1) / 2)) AS square
  FROM {rows} r JOIN mu ON r.model = mu.model AND r.j = mu.j GROUP BY id),
binned AS (SELECT r.id, r.model, r.j, CASE WHEN r.v = 0 THEN 0 ELSE 1 + len(list_filter(e.edges, lambda q: q <= r.v)) END AS bin FROM {rows} r JOIN e ON e.model = r.model AND e.j = r.j),
ev AS (
  SELECT b.id, sum(lr.llr) AS coord_total, coalesce(sum(lr.llr) FILTER (place < floor(p * 0.125)), 0) AS coord_g1, coalesce(sum(lr.llr) FILTER (place >= floor(p * 0.5)), 0) AS coord_g4, sum(iso.llr) AS monotonic_total
  FROM binned b JOIN lr ON b.model = lr.model AND b.j = lr.j AND b.bin = lr.bin JOIN iso ON b.model = iso.model AND b.j = iso.j AND b.bin = iso.bin JOIN st2 ON st2.model = b.model AND st2.j = b.j GROUP BY b.id)
SELECT ev.id, round(total, 6) + 0.0 AS total, CAST(zeros AS BIGINT) AS count_zeros, round(relative_std, 6) + 0.0 AS relative_std, round(max_share, 6) + 0.0 AS max_share, round(d_euclid_diff, 6) + 0.0 AS d_euclid_diff, round(proj_w, 6) + 0.0 AS proj_w,
  round(proj_w / ((size + 1e-10) * (wide + 1e-10)), 6) + 0.0 AS cos_w, round(dot / (wide + 1e-10), 6) + 0.0 AS mid_axis, round(sqrt(greatest(square - pow(dot / (wide + 1e-10), 2), 0)), 5) + 0.0 AS mid_orth,
  round(coord_total, 6) + 0.0 AS coord_total, round(coord_g1, 6) + 0.0 AS coord_g1, round(coord_g4, 6) + 0.0 AS coord_g4, round(monotonic_total, 5) + 0.0 AS monotonic_total
FROM ev JOIN geo ON ev.id = geo.id JOIN agg_f ON ev.id = agg_f.id"""


def _features(scored):
    a, c = F.col("aggregates"), F.col("centroids")
    return scored.select(
        "id", r6(a[0]).alias("total"), a[1].cast("long").alias("count_zeros"), r6(a[2]).alias("relative_std"), r6(a[3]).alias("max_share"), r6(c[0]).alias("d_euclid_diff"), r6(c[1]).alias("proj_w"), r6(c[2]).alias("cos_w"), r6(c[3]).alias("mid_axis"),
        (F.round(c[4], 5) + F.lit(0.0)).alias("mid_orth"), r6(F.col("coord")[0]).alias("coord_total"), r6(F.col("coord")[1]).alias("coord_g1"), r6(F.col("coord")[4]).alias("coord_g4"), (F.round(F.col("coord")[5], 5) + F.lit(0.0)).alias("monotonic_total"),
    )


@query("external_scores", f"""
WITH {_LOG_SQL}, {_STATES_SQL}, {PART_VEC},
xr AS (SELECT id, -1 AS model, unnest(generate_series(0, len(x) - 1)) AS j, ln(1 + unnest(x)) AS v FROM pv),{_features_sql("xr")}""")
def external_scores(spark, sf_dir):
    """Part vectors scored by what all order vectors taught: row statistics, centroid geometry and coordinate evidence."""
    return _features(fitted(spark, sf_dir, "linear_parts", True).transform(external_rows(spark, sf_dir)))


@query("builder_out_of_fold", f"""
WITH {_LOG_SQL}, {_STATES_SQL},
xr AS (SELECT l.id, f.fold AS model, l.j, l.v FROM l JOIN f ON l.id = f.id),{_features_sql("xr")}""")
def builder_out_of_fold(spark, sf_dir):
    """The order vectors themselves, each under the model that has not seen it."""
    return _features(fitted(spark, sf_dir, "linear_parts").out_of_fold(training_rows(spark, sf_dir)))


@query("builder_coverage", f"WITH {ORDER_VEC} SELECT CAST(1 AS BIGINT) AS times, count(*) AS n FROM v")
def builder_coverage(spark, sf_dir):
    """How often a row is scored out of fold: once."""
    rows = training_rows(spark, sf_dir)
    return E.coverage(fitted(spark, sf_dir, "baseline").out_of_fold(rows), rows)


@query("external_decisions")
def external_decisions(spark, sf_dir):
    """Decision and score of part vectors by a machine fitted on all seven blocks of the order vectors."""
    scored = fitted(spark, sf_dir, "blocks", True).transform(external_rows(spark, sf_dir))
    return scored.select("id", F.size("gaussians").alias("gaussians"), F.size("pca").alias("pcs"), r6(F.col("decision")[0]).alias("decision"), r6(F.col("decision")[1]).alias("score"))
