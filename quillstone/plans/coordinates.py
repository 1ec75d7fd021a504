"""Folds, scalers, coordinate likelihoods and single-feature quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import coordinates as K
from ..operators import folds
from ..operators.graph import cut_lineage
from ..operators.ranks import feature_auc, quantiles
from ..sources.fixtures import DOC_VEC, ORDER_VEC, VEC_PAIRS, VEC_RELU, long_form, order_vec, vec_pairs, vec_relu
from .register import query


def column():
    """The column's number as an int."""
    return F.col("j").cast("int").alias("j")


SEED, FOLDS, BINS, ALPHA = 11, 5, 8, 5.0

#: SQL of the pieces below; `fold` of each row and the models that may see it.
FOLD_SQL = f"f AS (SELECT id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || id), id) - 1) % {FOLDS} AS INTEGER) AS fold FROM v)"
TRAIN_SQL = f"""{FOLD_SQL},
m AS (SELECT unnest(range(-1, {FOLDS})) AS model),
t AS (SELECT m.model, l.id, l.j, l.v, l.y FROM l JOIN f ON l.id = f.id JOIN m ON f.fold <> m.model)"""
AUC_SQL = """
ar AS (SELECT *, rank() OVER (PARTITION BY model, j ORDER BY v) + (count(*) OVER (PARTITION BY model, j, v) - 1) / 2.0 AS rk FROM t),
au AS (SELECT model, j, CASE WHEN min(y) = max(y) THEN 0.5 ELSE (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) END AS auc FROM ar GROUP BY model, j),
st AS (SELECT *, round(abs(auc - 0.5), 9) AS strength, row_number() OVER (PARTITION BY model ORDER BY round(abs(auc - 0.5), 9) DESC, j DESC) - 1 AS place FROM au)"""


def _llr_sql(bins: int = BINS, alpha: float = ALPHA) -> str:
    qs = ", ".join(str(k / bins) for k in range(1, bins))
    return f"""
e AS (SELECT model, j, list_sort(list_distinct(list_filter(coalesce(quantile_cont(v, [{qs}]) FILTER (v > 0), []), lambda q: q IS NOT NULL))) AS edges FROM t GROUP BY model, j),
b AS (SELECT model, j, len(edges) + 2 AS b, unnest(range(0, len(edges) + 2)) AS bin FROM e),
tb AS (SELECT t.model, t.j, t.y, CASE WHEN t.v = 0 THEN 0 ELSE 1 + len(list_filter(e.edges, lambda q: q <= t.v)) END AS bin FROM t JOIN e ON t.model = e.model AND t.j = e.j),
cb AS (SELECT model, j, bin, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM tb GROUP BY model, j, bin),
fb AS (SELECT b.model, b.j, b.bin, b.b, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1 FROM b LEFT JOIN cb ON b.model = cb.model AND b.j = cb.j AND b.bin = cb.bin),
lr AS (SELECT *, ln((c1 + {alpha}) / (sum(c1) OVER w + {alpha} * b) / ((c0 + {alpha}) / (sum(c0) OVER w + {alpha} * b))) AS llr FROM fb WINDOW w AS (PARTITION BY model, j)),
ob AS (SELECT l.id, f.fold AS model, l.j, CASE WHEN l.v = 0 THEN 0 ELSE 1 + len(list_filter(e.edges, lambda q: q <= l.v)) END AS bin FROM l JOIN f ON l.id = f.id JOIN e ON e.model = f.fold AND e.j = l.j)"""


ISO_SQL = """
w AS (SELECT lr.model, lr.j, lr.bin, (c0 + c1)::DOUBLE AS w, llr * CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS v, row_number() OVER (PARTITION BY lr.model, lr.j ORDER BY lr.bin) AS k FROM lr JOIN au ON lr.model = au.model AND lr.j = au.j WHERE c0 + c1 > 0),
ab AS (SELECT a.model, a.j, a.k AS a, b.k AS b, sum(c.w * c.v) / sum(c.w) AS m FROM w a JOIN w b ON a.model = b.model AND a.j = b.j AND a.k <= b.k JOIN w c ON a.model = c.model AND a.j = c.j AND c.k BETWEEN a.k AND b.k GROUP BY ALL),
mn AS (SELECT i.model, i.j, i.k, a.a, min(a.m) AS m FROM w i JOIN ab a ON i.model = a.model AND i.j = a.j AND a.a <= i.k AND a.b >= i.k GROUP BY ALL),
fit AS (SELECT mn.model, mn.j, mn.k, max(m) AS v FROM mn GROUP BY ALL),
fb2 AS (SELECT w.model, w.j, w.bin, fit.v * CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS llr FROM w JOIN fit ON w.model = fit.model AND w.j = fit.j AND w.k = fit.k JOIN au ON w.model = au.model AND w.j = au.j),
iso AS (SELECT lr.model, lr.j, lr.bin, coalesce(arg_max(fb2.llr, fb2.bin) FILTER (fb2.bin <= lr.bin), arg_min(fb2.llr, fb2.bin)) AS llr FROM lr JOIN fb2 ON lr.model = fb2.model AND lr.j = fb2.j GROUP BY lr.model, lr.j, lr.bin)"""


def _folded(vec):
    """The long form with each row's fold."""
    fold = folds.stratified(vec, FOLDS, [SEED]).select("id", "fold")
    return long_form(vec.join(fold, "id").select("id", F.struct("y", "fold").alias("y"), "x")).select("id", "y.y", "y.fold", "j", "v")


def _oof_rows(long):
    """Each row for the model that has not seen it."""
    return long.select("id", F.col("fold").alias("model"), "j", "v")


def _fitted(long, bins=BINS, alpha=ALPHA):
    train = K.training_counts(long, FOLDS)
    edges = cut_lineage(K.fit_edges(train, bins), "coordinate-edges")  # a row per (model, column)
    return train, edges, K.fit_ratios(train, edges, alpha)


@query("stratified_folds", f"WITH {VEC_RELU}, {FOLD_SQL} SELECT v.id, v.y, f.fold FROM v JOIN f ON v.id = f.id")
def stratified_folds(spark, sf_dir):
    """Five folds with equal shares of the classes."""
    return folds.stratified(vec_relu(spark, sf_dir), FOLDS, [SEED]).select("id", "y", "fold")


@query("repeated_folds", f"""
WITH {ORDER_VEC}, s AS (SELECT unnest([0, 1, 2, 3, 4]) AS repeat, unnest([11, 12, 13, 14, 15]) AS seed), r AS (SELECT repeat, seed, y, (row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || id), id) - 1) % 5 AS fold FROM v, s)
SELECT CAST(repeat AS INTEGER) AS repeat, CAST(seed AS INTEGER) AS seed, y, CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL""")
def repeated_folds(spark, sf_dir):
    """Sizes of the classes in 5 x 5 folds over the order vectors."""
    return folds.stratified(order_vec(spark, sf_dir), 5, [11, 12, 13, 14, 15]).groupBy("repeat", "seed", "y", "fold").agg(F.count("*").alias("n"))


@query("nested_folds", f"""
WITH {VEC_RELU}, {FOLD_SQL}, o AS (SELECT v.id, v.y, f.fold FROM v JOIN f ON v.id = f.id)
SELECT id, fold, CAST((row_number() OVER (PARTITION BY fold, y ORDER BY md5((10000 + fold) || ':' || id), id) - 1) % 5 AS INTEGER) AS inner_fold FROM o""")
def nested_folds(spark, sf_dir):
    """Inner folds with the seed 10000 + fold inside each outer fold."""
    outer = folds.stratified(vec_relu(spark, sf_dir), FOLDS, [SEED]).select("id", "y", "fold")
    return folds.hashed_rank(outer, F.col("fold") + 10000, "id", "fold", "y").select("id", "fold", F.pmod("k", F.lit(5)).cast("int").alias("inner_fold"))


@query("holdout_split", f"""
WITH {ORDER_VEC}, r AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('5:' || id), id) - 1) % 20 AS k FROM v) SELECT id, y, k < 3 AS held_out FROM r""")
def holdout_split(spark, sf_dir):
    """A stratified hold-out of 15%."""
    return folds.stratified(order_vec(spark, sf_dir), 20, [5]).select("id", "y", (F.col("fold") < 3).alias("held_out"))


@query("group_folds", f"""
WITH {DOC_VEC}, g AS (SELECT x, count(*) AS n, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM v GROUP BY x)
SELECT c.y, c.n, g.groups, true AS whole, true AS even FROM (SELECT y, count(*) AS n FROM v GROUP BY y) c, (SELECT count(*) AS groups FROM g) g""")
def group_folds(spark, sf_dir):
    """Folds in which equal vectors stay together: by class, whether no group is cut and no fold is further from its even share than the largest group."""
    from ..sources.fixtures import doc_vec

    rows = folds.grouped(doc_vec(spark, sf_dir), FOLDS, "x")
    groups = rows.groupBy("x").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n"), *[F.count_if(F.col("y") == c).alias(f"n{c}") for c in (0, 1)])
    seen = groups.agg(F.count("*").alias("groups"), (F.max("folds") == 1).alias("whole"), F.max("n").alias("largest"))
    share = rows.groupBy("y", "fold").agg(F.count("*").alias("n")).groupBy("y").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.when(F.count("*") == FOLDS, F.min("n")).otherwise(0).alias("least"))
    even = F.greatest(F.col("most") - F.col("n") / FOLDS, F.col("n") / FOLDS - F.col("least")) <= F.col("largest")
    return share.join(F.broadcast(seen)).select("y", "n", "groups", "whole", even.alias("even"))


@query("bootstrap_draws", f"""
WITH {ORDER_VEC}, u AS (SELECT member, id, CAST('0x' || substr(md5('3:' || member || ':' || id), 1, 13) AS BIGINT) / {float(16**13)!r}::DOUBLE AS u FROM v, (SELECT unnest(range(10)) AS member))
SELECT CAST(member AS INTEGER) AS member, id, CAST(len(list_filter({folds.draw_steps()!r}::DOUBLE[], lambda s: s <= u)) AS INTEGER) AS weight FROM u WHERE u >= {folds.draw_steps()[0]!r}::DOUBLE""")
def bootstrap_draws(spark, sf_dir):
    """Rows drawn for ten bagging members."""
    return folds.bootstrap(order_vec(spark, sf_dir), 10, 3)


@query("oof_scaler", f"""
WITH {VEC_RELU}, {TRAIN_SQL}, s AS (SELECT model, j, avg(v) AS m, stddev_pop(v) AS sd FROM t GROUP BY model, j)
SELECT l.id, f.fold, CAST(l.j AS INTEGER) AS j, round((l.v - s.m) / CASE WHEN s.sd = 0 THEN 1 ELSE s.sd END, 6) + 0.0 AS z FROM l JOIN f ON l.id = f.id JOIN s ON s.model = f.fold AND s.j = l.j""")
def oof_scaler(spark, sf_dir):
    """Each row standardised by the other folds."""
    long = _folded(vec_relu(spark, sf_dir))
    state = K.training(long, FOLDS).groupBy("model", "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return _oof_rows(long).join(F.broadcast(state), ["model", "j"]).select("id", F.col("model").alias("fold"), column(), r6(z).alias("z"))  # a row per fold and column


@query("robust_scaler", f"""
WITH {ORDER_VEC}, s AS (SELECT j, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM l GROUP BY j)
SELECT id, CAST(l.j AS INTEGER) AS j, round((v - m) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) + 0.0 AS z FROM l JOIN s ON l.j = s.j""")
def robust_scaler(spark, sf_dir):
    """Values less the median, over the quartile range."""
    long = long_form(order_vec(spark, sf_dir))
    q = quantiles(long, [0.25, 0.5, 0.75], "j").select("j", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    return long.join(F.broadcast(q), "j").select("id", column(), r6((F.col("v") - F.col("m")) / F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr"))).alias("z"))


@query("bin_counts", f"""
WITH {VEC_RELU}, {TRAIN_SQL},{_llr_sql()}
SELECT CAST(model AS INTEGER) AS model, CAST(j AS INTEGER) AS j, CAST(bin AS INTEGER) AS bin, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, round(llr, 6) + 0.0 AS llr FROM lr""")
def bin_counts(spark, sf_dir):
    """Class counts and log ratios of every bin of every model."""
    _, _, ratios = _fitted(_folded(vec_relu(spark, sf_dir)))
    return ratios.select("model", column(), F.col("bin").cast("int").alias("bin"), "c0", "c1", r6(F.col("llr")).alias("llr"))


@query("coord_llr", f"""
WITH {VEC_RELU}, {TRAIN_SQL},{_llr_sql()}
SELECT ob.id, round(sum(lr.llr), 6) + 0.0 AS total FROM ob JOIN lr ON ob.model = lr.model AND ob.j = lr.j AND ob.bin = lr.bin GROUP BY ob.id""")
def coord_llr(spark, sf_dir):
    """Out-of-fold sum of the log ratios of each row's coordinates."""
    long = _folded(vec_relu(spark, sf_dir))
    _, edges, ratios = _fitted(long)
    return K.score(_oof_rows(long), edges, ratios).groupBy("id").agg(r6(F.sum("llr")).alias("total"))


@query("coord_llr_orders", f"""
WITH {ORDER_VEC}, {TRAIN_SQL},{_llr_sql()}
SELECT ob.id, round(sum(lr.llr), 6) + 0.0 AS total FROM ob JOIN lr ON ob.model = lr.model AND ob.j = lr.j AND ob.bin = lr.bin GROUP BY ob.id""")
def coord_llr_orders(spark, sf_dir):
    """The same over the order vectors, the volume case."""
    long = _folded(order_vec(spark, sf_dir))
    _, edges, ratios = _fitted(long)
    return K.score(_oof_rows(long), edges, ratios).groupBy("id").agg(r6(F.sum("llr")).alias("total"))


@query("coord_llr_monotonic", f"""
WITH {ORDER_VEC}, {TRAIN_SQL},{_llr_sql()},{AUC_SQL},{ISO_SQL}
SELECT ob.id, round(sum(iso.llr), 5) + 0.0 AS total FROM ob JOIN iso ON ob.model = iso.model AND ob.j = iso.j AND ob.bin = iso.bin GROUP BY ob.id""")
def coord_llr_monotonic(spark, sf_dir):
    """The out-of-fold sum with the log ratios of each column made monotone."""
    long = _folded(order_vec(spark, sf_dir))
    train, edges, ratios = _fitted(long)
    up = K.strengths(train).select("model", "j", (F.col("auc") >= 0.5).alias("up"))
    return K.score(_oof_rows(long), edges, K.isotonic(ratios, up)).groupBy("id").agg((F.round(F.sum("llr"), 5) + F.lit(0.0)).alias("total"))


@query("coord_llr_groups", f"""
WITH {VEC_RELU}, {TRAIN_SQL},{_llr_sql()},{AUC_SQL}
SELECT ob.id, round(sum(llr) FILTER (place < 8), 6) + 0.0 AS g1, round(sum(llr) FILTER (place BETWEEN 8 AND 15), 6) + 0.0 AS g2, round(sum(llr) FILTER (place BETWEEN 16 AND 31), 6) + 0.0 AS g3, round(sum(llr) FILTER (place >= 32), 6) + 0.0 AS g4
FROM ob JOIN lr ON ob.model = lr.model AND ob.j = lr.j AND ob.bin = lr.bin JOIN st ON st.model = ob.model AND st.j = ob.j GROUP BY ob.id""")
def coord_llr_groups(spark, sf_dir):
    """Sums over groups of columns by strength: the first eighth, to a quarter, to a half, the rest."""
    long = _folded(vec_relu(spark, sf_dir))
    train, edges, ratios = _fitted(long)
    places = F.broadcast(K.strengths(train).select("model", "j", "place"))  # a row per model and column
    s = K.score(_oof_rows(long), edges, ratios).join(places, ["model", "j"])
    cuts = [(0, 7), (8, 15), (16, 31), (32, 1 << 30)]
    return s.groupBy("id").agg(*[r6(F.sum(F.when(F.col("place").between(a, b), F.col("llr")))).alias(f"g{i}") for i, (a, b) in enumerate(cuts, 1)])


@query("evidence_binned", f"""
WITH {VEC_RELU}, {TRAIN_SQL},{_llr_sql(12)}
SELECT ob.id, CAST(ob.j AS INTEGER) AS j, round(least(greatest(lr.llr, -9.21), 9.21), 6) + 0.0 AS evidence FROM ob JOIN lr ON ob.model = lr.model AND ob.j = lr.j AND ob.bin = lr.bin""")
def evidence_binned(spark, sf_dir):
    """The log ratio of every coordinate (12 bins), the dimension kept."""
    long = _folded(vec_relu(spark, sf_dir))
    _, edges, ratios = _fitted(long, bins=12)
    clipped = F.least(F.greatest(F.col("llr"), F.lit(-9.21)), F.lit(9.21))
    return K.score(_oof_rows(long), edges, ratios).select("id", column(), r6(clipped).alias("evidence"))


@query("llr_sensitivity", " UNION ALL ".join(f"""
SELECT * FROM (WITH {ORDER_VEC}, {TRAIN_SQL},{_llr_sql(b, a)}
SELECT {b} AS bins, CAST({a} AS DOUBLE) AS alpha, CAST(j AS INTEGER) AS j, round(max(llr) - min(llr), 6) AS spread FROM lr WHERE model = -1 GROUP BY j)""" for b, a in ((4, 1.0), (8, 5.0), (12, 5.0), (16, 10.0))))
def llr_sensitivity(spark, sf_dir):
    """Spread of the log ratios of each column under four pairs of bins and smoothing."""
    train = K.training_counts(_folded(order_vec(spark, sf_dir)), FOLDS).where("model = -1")
    out = None
    for bins, alpha in ((4, 1.0), (8, 5.0), (12, 5.0), (16, 10.0)):
        ratios = K.fit_ratios(train, K.fit_edges(train, bins), alpha)
        part = ratios.groupBy("j").agg(r6(F.max("llr") - F.min("llr")).alias("spread")).select(F.lit(bins).alias("bins"), F.lit(alpha).alias("alpha"), column(), "spread")
        out = part if out is None else out.unionByName(part)
    return out


_FEATURE_AUC = "t AS (SELECT 0 AS model, * FROM l WHERE y IS NOT NULL)," + AUC_SQL


@query("feature_auc", f"WITH {VEC_RELU}, {_FEATURE_AUC} SELECT CAST(j AS INTEGER) AS j, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS best, CAST(place AS INTEGER) AS place FROM st ORDER BY place LIMIT 10")
def feature_auc_top(spark, sf_dir):
    """The flagship: the ten coordinates that best separate the classes."""
    long = long_form(vec_relu(spark, sf_dir)).withColumn("model", F.lit(0))
    s = K.strengths(long).orderBy("place").limit(10)
    return s.select(column(), r6(F.col("auc")).alias("auc"), r6(F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("best"), F.col("place").cast("int").alias("place"))


@query("feature_auc_all", f"WITH {ORDER_VEC}, {_FEATURE_AUC} SELECT CAST(j AS INTEGER) AS j, round(auc, 6) AS auc FROM au")
def feature_auc_all(spark, sf_dir):
    """AUC of every column of the order vectors."""
    return feature_auc(long_form(order_vec(spark, sf_dir)), "j").select(column(), r6(F.col("auc")).alias("auc"))


@query("pair_feature_auc", f"WITH {VEC_PAIRS}, {_FEATURE_AUC} SELECT CAST(j AS INTEGER) AS j, round(auc, 6) AS auc FROM au")
def pair_feature_auc(spark, sf_dir):
    """AUC of every column of the pair vectors, with few positives."""
    return feature_auc(long_form(vec_pairs(spark, sf_dir)), "j").select(column(), r6(F.col("auc")).alias("auc"))


@query("univariate_weights", f"""
WITH {VEC_RELU}, {_FEATURE_AUC}, d AS (SELECT j, abs(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / sqrt((var_samp(v) FILTER (y = 1) + var_samp(v) FILTER (y = 0)) / 2 + 1e-10) AS d FROM l GROUP BY j)
SELECT CAST(st.j AS INTEGER) AS j, round(pow(abs(auc - 0.5) / max(abs(auc - 0.5)) OVER (), 0.5), 5) AS weight, round(d, 6) AS effect FROM st JOIN d ON st.j = d.j""")
def univariate_weights(spark, sf_dir):
    """Weights of the columns: the power 0.5 of the relative strength, and the standardised class gap."""
    long = long_form(vec_relu(spark, sf_dir))
    s = feature_auc(long, "j").select("j", F.abs(F.col("auc") - 0.5).alias("s"))
    top = F.broadcast(s.agg(F.max("s").alias("top")))  # one row
    of = lambda f, c: f(F.when(F.col("y") == c, F.col("v")))
    d = long.groupBy("j").agg((F.abs(of(F.avg, 1) - of(F.avg, 0)) / F.sqrt((of(F.var_samp, 1) + of(F.var_samp, 0)) / 2 + 1e-10)).alias("d"))
    return s.join(top).join(d, "j").select(column(), F.round(F.pow(F.col("s") / F.col("top"), F.lit(0.5)), 5).alias("weight"), r6(F.col("d")).alias("effect"))


@query("class_centroid_geometry", f"""
WITH {VEC_RELU}, {TRAIN_SQL}, c AS (SELECT model, j, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM t GROUP BY model, j)
SELECT l.id, f.fold, round(sqrt(sum((v - m0) * (v - m0))) - sqrt(sum((v - m1) * (v - m1))), 6) + 0.0 AS d_diff, round(sum(v * (m1 - m0)), 6) + 0.0 AS projection,
  round(sum(v * (m1 - m0)) / greatest(sqrt(sum(v * v)) * sqrt(sum((m1 - m0) * (m1 - m0))), 1e-10), 6) + 0.0 AS cosine,
  round(sum((v - (m0 + m1) / 2) * (m1 - m0)) / greatest(sqrt(sum((m1 - m0) * (m1 - m0))), 1e-10), 6) + 0.0 AS axis
FROM l JOIN f ON l.id = f.id JOIN c ON c.model = f.fold AND c.j = l.j GROUP BY l.id, f.fold""")
def class_centroid_geometry(spark, sf_dir):
    """Out-of-fold distances to the class means, projection and cosine on their difference, and place on the axis."""
    vec = vec_relu(spark, sf_dir)
    long = _folded(vec)
    of = lambda c: F.avg(F.when(F.col("y") == c, F.col("v")))
    means = K.training(long, FOLDS).groupBy("model", "j").agg(of(0).alias("m0"), of(1).alias("m1"))
    state = means.groupBy(F.col("model").alias("fold")).agg(F.array_sort(F.collect_list(F.struct("j", "m0", "m1"))).alias("s")).select("fold", F.col("s.m0").alias("m0"), F.col("s.m1").alias("m1"))
    fold = folds.stratified(vec, FOLDS, [SEED]).select("id", "fold")
    rows = vec.join(fold, "id").join(F.broadcast(state), "fold")  # a row per fold
    rows = rows.withColumn("w", F.zip_with("m1", "m0", lambda a, b: a - b)).withColumn("centred", F.zip_with("x", F.zip_with("m0", "m1", lambda a, b: (a + b) / 2), lambda a, b: a - b))
    x, w, floor = F.col("x"), F.col("w"), lambda c: F.greatest(c, F.lit(V.EPS))
    return rows.select(
        "id", "fold", r6(F.sqrt(V.squared_distance(x, F.col("m0"))) - F.sqrt(V.squared_distance(x, F.col("m1")))).alias("d_diff"), r6(V.dot(x, w)).alias("projection"),
        r6(V.dot(x, w) / floor(V.norm(x, 2) * V.norm(w, 2))).alias("cosine"), r6(V.dot(F.col("centred"), w) / floor(V.norm(w, 2))).alias("axis"),
    )
