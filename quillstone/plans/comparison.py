"""Model comparison: fold AUCs, rank blends, paired differences, selection rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.vectors import r6
from ..operators import comparison as M
from ..operators import folds
from ..operators.ranks import average_rank_by_counts, feature_auc, quantiles
from ..sources.fixtures import ORDER_VEC, VEC_RELU, long_form, order_vec, vec_relu
from .register import query

SEEDS = [21, 22]
_OOF = f"""{ORDER_VEC},
s AS (SELECT unnest([0, 1]) AS repeat, unnest([21, 22]) AS seed),
f AS (SELECT repeat, id, (row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || id), id) - 1) % 5 AS fold FROM v, s),
o AS (SELECT l.j AS model, f.repeat, f.fold, l.id, l.y, l.v AS score FROM l JOIN f ON l.id = f.id),
rk AS (SELECT *, rank() OVER (PARTITION BY model, repeat, fold ORDER BY score) + (count(*) OVER (PARTITION BY model, repeat, fold, score) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY model, repeat, fold) AS n FROM o),
a AS (SELECT model, repeat, fold, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM rk GROUP BY ALL)"""
#: Fixed configurations of the blends: name, model, weight before it is normalised.
CONFIG = [("even", m, 1.0) for m in range(8)] + [("front", 0, 3.0), ("front", 3, 1.0), ("pair", 2, 0.8), ("pair", 7, 0.2)]
_CONFIG = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {m}, {w}::DOUBLE)" for n, m, w in CONFIG) + ") AS t(name, model, weight)), cn AS (SELECT name, model, weight / sum(weight) OVER (PARTITION BY name) AS weight FROM c)"


def oof(spark, sf_dir):
    """Out-of-fold scores of eight single-column models in two repeats of five folds."""
    vec = order_vec(spark, sf_dir)
    fold = folds.stratified(vec, 5, SEEDS).select("repeat", "id", "fold")
    return long_form(vec).join(fold, "id").select(F.col("j").alias("model"), "repeat", "fold", "id", "y", F.col("v").alias("score"))


def config(spark):
    return spark.createDataFrame(CONFIG, "name string, model int, weight double")


@query("percentile_rank", f"WITH {VEC_RELU} SELECT id, CAST(j AS INTEGER) AS j, round((rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0) / count(*) OVER (PARTITION BY j), 6) AS r FROM l")
def percentile_rank(spark, sf_dir):
    """Average ranks over the number of rows, per column."""
    long = long_form(vec_relu(spark, sf_dir)).select("id", "j", F.col("v").alias("score"))
    return M.ranked(long, "j").select("id", F.col("j").cast("int").alias("j"), r6(F.col("r")).alias("r"))


@query("ecdf_position", f"WITH {VEC_RELU} SELECT id, CAST(j AS INTEGER) AS j, round(least(greatest((count(*) OVER (PARTITION BY j ORDER BY v RANGE UNBOUNDED PRECEDING) + 0.5) / (count(*) OVER (PARTITION BY j) + 1), 1e-4), 1 - 1e-4), 6) AS u FROM l")
def ecdf_position(spark, sf_dir):
    """(rows up to the value + 0.5) / (rows + 1) per column, clipped."""
    long = long_form(vec_relu(spark, sf_dir)).select("id", "j", "v")
    ranks = average_rank_by_counts(long, "v", "j").select("j", "v", (F.col("rank") + (F.col("n") - 1) / 2.0).alias("upto"))
    n = F.broadcast(long.groupBy("j").agg(F.count("*").alias("m")))  # a row per column
    u = (F.col("upto") + 0.5) / (F.col("m") + 1)
    return long.join(ranks, ["j", "v"]).join(n, "j").select("id", F.col("j").cast("int").alias("j"), r6(F.least(F.greatest(u, F.lit(1e-4)), F.lit(1 - 1e-4))).alias("u"))


@query("fold_auc", f"WITH {_OOF} SELECT CAST(model AS INTEGER) AS model, CAST(repeat AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, round(auc, 6) AS auc FROM a")
def fold_auc(spark, sf_dir):
    """AUC per model, repeat and fold."""
    return M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold").select(F.col("model").cast("int").alias("model"), "repeat", "fold", r6(F.col("auc")).alias("auc"))


@query("fold_summary", f"WITH {_OOF} SELECT CAST(model AS INTEGER) AS model, CAST(count(*) AS BIGINT) AS folds, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std, round(median(auc), 6) AS median, round(min(auc), 6) AS min, round(max(auc), 6) AS max FROM a GROUP BY model")
def fold_summary(spark, sf_dir):
    """Mean, deviation, median and range of the fold AUCs of each model."""
    a = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold")
    return a.groupBy(F.col("model").cast("int").alias("model")).agg(F.count("*").alias("folds"), *[r6(f("auc")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("median", F.median), ("min", F.min), ("max", F.max))])


@query("foldwise_rank", f"WITH {_OOF} SELECT CAST(model AS INTEGER) AS model, CAST(repeat AS INTEGER) AS repeat, id, round(k / n, 6) AS r FROM rk")
def foldwise_rank(spark, sf_dir):
    """Percentile ranks inside each fold of every model."""
    return M.ranked(oof(spark, sf_dir), "model", "repeat", "fold").select(F.col("model").cast("int").alias("model"), "repeat", "id", r6(F.col("r")).alias("r"))


@query("rank_blend", f"WITH {_OOF}, {_CONFIG} SELECT name, CAST(repeat AS INTEGER) AS repeat, id, round(sum(weight * k / n), 6) AS score FROM rk JOIN cn ON rk.model = cn.model GROUP BY name, repeat, id")
def rank_blend(spark, sf_dir):
    """Weighted sums of the ranks inside folds for all configurations at once."""
    ranks = M.ranked(oof(spark, sf_dir), "model", "repeat", "fold")
    return M.rank_blend(ranks, config(spark), "repeat", "id").select("name", "repeat", "id", r6(F.col("score")).alias("score"))


@query("blend_auc", f"""
WITH {_OOF}, {_CONFIG}, b AS (SELECT name, repeat, fold, id, y, round(sum(weight * k / n), 9) AS score FROM rk JOIN cn ON rk.model = cn.model GROUP BY ALL),
br AS (SELECT *, rank() OVER (PARTITION BY name, repeat, fold ORDER BY score) + (count(*) OVER (PARTITION BY name, repeat, fold, score) - 1) / 2.0 AS q FROM b)
SELECT name, CAST(repeat AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, round((sum(q) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM br GROUP BY ALL""")
def blend_auc(spark, sf_dir):
    """Fold AUCs of the blends."""
    ranks = M.ranked(oof(spark, sf_dir), "model", "repeat", "fold")
    b = M.rank_blend(ranks, config(spark), "repeat", "fold", "id", "y").withColumn("score", F.round("score", 9))
    return M.fold_auc(b, "name", "repeat", "fold").select("name", "repeat", "fold", r6(F.col("auc")).alias("auc"))


@query("final_rank_blend", f"""
WITH {ORDER_VEC}, {_CONFIG}, k AS (SELECT id, j, (rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0) / count(*) OVER (PARTITION BY j) AS r FROM l),
b AS (SELECT name, id, round(sum(weight * r), 9) AS score FROM k JOIN cn ON k.j = cn.model GROUP BY name, id)
SELECT name, id, round((rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1) / 2.0) / count(*) OVER (PARTITION BY name), 6) AS r FROM b""")
def final_rank_blend(spark, sf_dir):
    """Ranks over all rows, blended and ranked again: the scores that are handed in."""
    long = long_form(order_vec(spark, sf_dir)).select(F.col("j").alias("model"), "id", F.col("v").alias("score"))
    b = M.rank_blend(M.ranked(long, "model"), config(spark), "id").withColumn("score", F.round("score", 9))
    return M.ranked(b, "name").select("name", "id", r6(F.col("r")).alias("r"))


@query("paired_deltas", f"""
WITH {_OOF}, d AS (SELECT x.model, round(x.auc - b.auc, 12) AS d FROM a x JOIN a b ON b.model = 0 AND x.repeat = b.repeat AND x.fold = b.fold WHERE x.model <> 0),
w AS (SELECT *, rank() OVER (PARTITION BY model, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS k FROM d)
SELECT CAST(model AS INTEGER) AS model, round(avg(d), 6) + 0.0 AS mean, round(stddev_pop(d), 6) AS std, round(median(d), 6) + 0.0 AS median, round(min(d), 6) + 0.0 AS min, round(max(d), 6) + 0.0 AS max, CAST(count(*) FILTER (d > 1e-12) AS BIGINT) AS wins, CAST(count(*) FILTER (d < -1e-12) AS BIGINT) AS losses, CAST(count(*) FILTER (abs(d) <= 1e-12) AS BIGINT) AS ties,
  CAST(coalesce(sum(k) FILTER (d > 0), 0) AS DOUBLE) AS w_plus FROM w GROUP BY model""")
def paired_deltas(spark, sf_dir):
    """Each model against the first over the same folds."""
    p = M.paired(M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold"), 0)
    return p.select(F.col("model").cast("int").alias("model"), *[r6(F.col(c)).alias(c) for c in ("mean", "std", "median", "min", "max")], "wins", "losses", "ties", F.col("w_plus").cast("double").alias("w_plus"))


_TABLE = "t AS (SELECT 'm' || model AS name, avg(auc) AS cv, model % 3 / 2.0 AS raw_weight, 1 + model % 4 AS blocks FROM a GROUP BY model)"


def _table(spark, sf_dir):
    a = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold").groupBy("model").agg(F.avg("auc").alias("cv"))
    return a.select(F.concat(F.lit("m"), "model").alias("name"), "cv", (F.col("model") % 3 / 2.0).alias("raw_weight"), (1 + F.col("model") % 4).alias("blocks"))


@query("config_select_tolerance", f"WITH {_OOF}, {_TABLE} SELECT name, round(cv, 6) AS cv, CAST(raw_weight AS DOUBLE) AS raw_weight, CAST(blocks AS INTEGER) AS blocks FROM t WHERE cv >= (SELECT max(cv) FROM t) - 0.01 ORDER BY raw_weight DESC, blocks, t.cv DESC, name LIMIT 1")
def config_select_tolerance(spark, sf_dir):
    """The simplest configuration within the tolerance of the best."""
    return M.select_simplest(_table(spark, sf_dir), 0.01).select("name", r6(F.col("cv")).alias("cv"), F.col("raw_weight").cast("double").alias("raw_weight"), F.col("blocks").cast("int").alias("blocks"))


@query("config_near_best_std", f"WITH {_OOF}, g AS (SELECT model, avg(auc) AS cv, stddev_pop(auc) AS sd FROM a GROUP BY model) SELECT CAST(model AS INTEGER) AS model, round(cv, 6) AS cv, round(sd, 6) AS std FROM g WHERE cv >= (SELECT max(cv) FROM g) - 0.01 ORDER BY sd, model LIMIT 1")
def config_near_best_std(spark, sf_dir):
    """The steadiest model near the best mean."""
    g = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold").groupBy("model").agg(F.avg("auc").alias("cv"), F.stddev_pop("auc").alias("sd"))
    best = F.broadcast(g.agg(F.max("cv").alias("best")))  # one row
    return g.join(best).where("cv >= best - 0.01").orderBy("sd", "model").limit(1).select(F.col("model").cast("int").alias("model"), r6(F.col("cv")).alias("cv"), r6(F.col("sd")).alias("std"))


@query("stability_gate", f"WITH {_OOF}, g AS (SELECT model, avg(auc) AS m, stddev_pop(auc) AS sd, count(*) FILTER (auc > 0.5) AS wins FROM a GROUP BY model) SELECT CAST(model AS INTEGER) AS model, round(m, 6) AS mean, round(sd, 6) AS std FROM g WHERE m >= 0.49 AND wins >= 3 AND sd <= 0.05")
def stability_gate(spark, sf_dir):
    """Models that pass a gate on mean, wins and deviation."""
    s = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold").groupBy("model").agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("sd"), F.count_if(F.col("auc") > 0.5).alias("wins"))
    return s.where("m >= 0.49 AND wins >= 3 AND sd <= 0.05").select(F.col("model").cast("int").alias("model"), r6(F.col("m")).alias("mean"), r6(F.col("sd")).alias("std"))


_WEIGHTS = f"""{_OOF}, g AS (SELECT model, round(abs(avg(auc) - 0.5), 9) AS s FROM a GROUP BY model),
cw AS (SELECT 'even' AS name, model, 1.0::DOUBLE AS weight FROM g UNION ALL SELECT 'strength', model, s FROM g UNION ALL SELECT 'square', model, s * s FROM g UNION ALL SELECT 'root', model, sqrt(s) FROM g),
cn AS (SELECT name, model, weight / sum(weight) OVER (PARTITION BY name) AS weight FROM cw)"""


@query("weight_l1_diverse", f"WITH {_WEIGHTS} SELECT x.name AS a, y.name AS b, round(sum(abs(x.weight - y.weight)), 6) AS l1 FROM cn x JOIN cn y ON x.model = y.model AND x.name < y.name GROUP BY x.name, y.name HAVING l1 >= 0.08")
def weight_l1_diverse(spark, sf_dir):
    """Pairs of configurations whose weights differ by 0.08 in sum; the weights are even, or follow from the models' mean AUC over folds."""
    s = F.round(F.abs(F.avg("auc") - 0.5), 9)
    strength = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold").groupBy("model").agg(s.alias("s"))
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), w.alias("weight")) for n, w in (("even", F.lit(1.0)), ("strength", F.col("s")), ("square", F.col("s") * F.col("s")), ("root", F.sqrt("s")))])
    c = M.normalized(strength.select("model", F.explode(kinds).alias("c")).select("c.name", "model", "c.weight"))
    met = c.alias("x").join(c.alias("y"), (F.col("x.model") == F.col("y.model")) & (F.col("x.name") < F.col("y.name")))  # a row per model and configuration
    l1 = met.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.sum(F.abs(F.col("x.weight") - F.col("y.weight"))).alias("l1"))
    return l1.select("a", "b", r6(F.col("l1")).alias("l1")).where("l1 >= 0.08")


@query("paired_signed_rank", f"""
WITH {_OOF}, b AS (SELECT repeat, fold, auc FROM a WHERE model = 3),
d AS (SELECT a.model, a.repeat, a.fold, round(a.auc - b.auc, 12) AS d FROM a JOIN b ON a.repeat = b.repeat AND a.fold = b.fold WHERE a.model <> 3),
r AS (SELECT model, d, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS k, row_number() OVER (PARTITION BY model ORDER BY abs(d), repeat, fold) - 1 AS i FROM d WHERE d <> 0),
w AS (SELECT model, count(*) AS n, sum(k) FILTER (d > 0) AS up, sum(k) AS whole FROM r GROUP BY model),
t AS (SELECT w.model, m.mask, coalesce(sum(r.k) FILTER (CAST(floor(m.mask / pow(2, r.i)) AS BIGINT) % 2 = 1), 0) AS total FROM w, (SELECT unnest(range(1024)) AS mask) m, r WHERE m.mask < pow(2, w.n) AND r.model = w.model GROUP BY w.model, m.mask)
SELECT CAST(w.model AS INTEGER) AS model, CAST(n AS BIGINT) AS n, round(coalesce(up, 0), 6) AS w_plus, round(least(1, 2.0 * count(*) FILTER (total <= least(coalesce(up, 0), whole - coalesce(up, 0)) + 1e-9) / count(*)), 6) AS p FROM w JOIN t ON w.model = t.model GROUP BY w.model, n, up, whole""")
def paired_signed_rank(spark, sf_dir):
    """The exact two-sided p of each model's differences to the baseline over the folds, ties sharing their ranks."""
    auc = M.fold_auc(oof(spark, sf_dir), "model", "repeat", "fold")
    base = auc.where("model = 3").select("repeat", "fold", F.col("auc").alias("base"))
    d = auc.where("model <> 3").join(F.broadcast(base), ["repeat", "fold"]).groupBy("model").agg(F.collect_list(F.round(F.col("auc") - F.col("base"), 12)).alias("d"))  # a number per fold

    @F.pandas_udf("w_plus double, p double")
    def tested(d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(M.signed_rank_sum(list(x)), M.signed_rank_p(list(x))) for x in d], columns=["w_plus", "p"])

    found = d.select("model", F.size(F.filter("d", lambda x: x != 0)).cast("long").alias("n"), tested("d").alias("t"))
    return found.where("n > 0").select(F.col("model").cast("int").alias("model"), "n", r6(F.col("t.w_plus")).alias("w_plus"), r6(F.col("t.p")).alias("p"))


@query("prediction_complementarity", f"""
WITH {ORDER_VEC}, r AS (SELECT id, y, j, v, (rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0) / count(*) OVER (PARTITION BY j) AS r FROM l),
p AS (SELECT b.j AS model, a.y, a.v AS va, b.v AS vb, a.r AS ra, b.r AS rb, round(abs(a.r - b.r), 12) AS gap FROM r a JOIN r b ON a.id = b.id AND a.j = 3 AND b.j <> 3),
q AS (SELECT *, quantile_cont(gap, 0.75) OVER (PARTITION BY model) AS q75 FROM p),
k AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY vb) + (count(*) OVER (PARTITION BY model, vb) - 1) / 2.0 AS k FROM q WHERE gap >= q75),
u AS (SELECT model, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k GROUP BY model)
SELECT CAST(q.model AS INTEGER) AS model, round(corr(va, vb), 6) + 0.0 AS pearson, round(corr(ra, rb), 6) + 0.0 AS spearman, round(avg(gap), 6) AS mean_gap, round(any_value(u.auc), 6) AS apart_auc FROM q JOIN u ON q.model = u.model GROUP BY q.model""")
def prediction_complementarity(spark, sf_dir):
    """Each model against a reference: correlations of scores and ranks, mean difference in rank, and its AUC on the quarter of rows that the two rank most differently."""
    long = long_form(order_vec(spark, sf_dir)).select("id", "y", "j", F.col("v").alias("score"))
    rows = M.ranked(long, "j").groupBy("id", "y").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("score", "r")))).alias("m"))  # a row per model
    of = lambda j: F.element_at("m", j)
    pairs = rows.select("y", of(F.lit(3)).alias("a"), F.explode("m").alias("model", "b")).where("model <> 3").withColumn("v", F.round(F.abs(F.col("a.r") - F.col("b.r")), 12))
    whole = pairs.groupBy("model").agg(F.corr("a.score", "b.score").alias("pearson"), F.corr("a.r", "b.r").alias("spearman"), F.avg("v").alias("mean_gap"))
    bar = F.broadcast(quantiles(pairs, [0.75], "model").select("model", F.col("q")[0].alias("q75")))  # a row per model
    apart = pairs.join(bar, "model").where("v >= q75").select("model", "y", F.col("b.score").alias("v"))
    found = whole.join(feature_auc(apart, "model").select("model", F.col("auc").alias("apart_auc")), "model")
    return found.select(F.col("model").cast("int").alias("model"), *[r6(F.col(c)).alias(c) for c in ("pearson", "spearman", "mean_gap", "apart_auc")])


@query("oof_correlation", f"WITH {_OOF} SELECT CAST(x.model AS INTEGER) AS a, CAST(y.model AS INTEGER) AS b, round(corr(x.k / x.n, y.k / y.n), 6) + 0.0 AS r FROM rk x JOIN rk y ON x.id = y.id AND x.repeat = y.repeat AND x.model < y.model GROUP BY x.model, y.model")
def oof_correlation(spark, sf_dir):
    """Correlations of the fold ranks between models; models of a row meet inside its own group."""
    r = M.ranked(oof(spark, sf_dir), "model", "repeat", "fold").groupBy("repeat", "id").agg(F.collect_list(F.struct("model", "r")).alias("m"))  # a row per model
    pairs = r.select(F.explode("m").alias("p"), "m").select("p", F.explode(F.filter("m", lambda t: t.model > F.col("p.model"))).alias("q"))
    return pairs.groupBy(F.col("p.model").cast("int").alias("a"), F.col("q.model").cast("int").alias("b")).agg(r6(F.corr("p.r", "q.r")).alias("r"))


@query("complementarity", f"""
WITH {ORDER_VEC}, r AS (SELECT id, y, j, (rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0) / count(*) OVER (PARTITION BY j) AS r FROM l WHERE j IN (0, 3)),
p AS (SELECT a.id, a.r AS ra, b.r AS rb, abs(a.r - b.r) AS gap FROM r a JOIN r b ON a.id = b.id AND a.j = 0 AND b.j = 3)
SELECT round(corr(ra, rb), 6) AS spearman, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.75), 6) AS q75, CAST(count(*) FILTER (gap >= 0.5) AS BIGINT) AS n_apart FROM p""")
def complementarity(spark, sf_dir):
    """How two models differ in rank."""
    long = long_form(order_vec(spark, sf_dir)).where("j IN (0, 3)").select("id", "j", F.col("v").alias("score"))
    r = M.ranked(long, "j").groupBy("id").agg(F.max(F.when(F.col("j") == 0, F.col("r"))).alias("ra"), F.max(F.when(F.col("j") == 3, F.col("r"))).alias("rb")).withColumn("v", F.abs(F.col("ra") - F.col("rb")))
    one = r.agg(r6(F.corr("ra", "rb")).alias("spearman"), r6(F.avg("v")).alias("mean_gap"), F.count_if(F.col("v") >= 0.5).alias("n_apart"))
    return one.join(quantiles(r, [0.75]).select(r6(F.col("q")[0]).alias("q75")))  # one row each


@query("auc_pair_quantum", f"WITH {ORDER_VEC} SELECT CAST(count(*) FILTER (y = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (y = 1) AS BIGINT) AS n1, round(1e9 / (count(*) FILTER (y = 0) * count(*) FILTER (y = 1)), 6) AS quantum_e9 FROM v")
def auc_pair_quantum(spark, sf_dir):
    """The least step of an AUC."""
    n = order_vec(spark, sf_dir).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return n.select("n0", "n1", r6(1e9 / (F.col("n0") * F.col("n1"))).alias("quantum_e9"))
