"""Isotonic evidence, calibration, quantile places, factor models, boosting by stages, column hierarchies and projections."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import estimators as E
from ..operators import extra_trees, folds, hierarchy, search, staged
from ..operators import learners as L
from ..operators.graph import cut_lineage, scratch_root
from ..operators.isotonic import Isotonic
from ..operators.metric import Metric
from ..operators.parallel import side_by_side
from ..operators.ranks import feature_auc
from ..sources.fixtures import ORDER_VEC, VEC_RELU, order_vec, vec_relu
from .coordinates import AUC_SQL, FOLDS, SEED, TRAIN_SQL
from .register import query


def _folded(vec, k=FOLDS):
    fold = folds.stratified(vec, k, [SEED]).select("id", "fold")
    return vec.join(fold, "id").select("id", "y", "fold", "x")


def _out_of_fold(rows, estimator):
    """The block of each row by the model of the other folds."""
    rows = cut_lineage(rows, "learned-rows")
    return E.Builder([E.Step("block", estimator)], FOLDS).fit(rows).out_of_fold(rows)


#: The columns of the order vectors that have few values: counts, discount, tax.
FEW = (0, 1, 5, 6, 7)
_FEW_SQL = f"""{ORDER_VEC.rsplit("l AS (", 1)[0].replace("v AS (", "raw AS (", 1)}
v AS (SELECT id, [{", ".join(f"x[{j + 1}]" for j in FEW)}] AS x, y FROM raw),
l AS (SELECT id, y, unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM v)"""


@query("evidence_isotonic", f"""
WITH {_FEW_SQL}, {TRAIN_SQL},{AUC_SQL},
s AS (SELECT model, j, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM au),
c AS (SELECT t.model, t.j, t.v * sign AS v, count(*) AS n, sum(t.y) AS pos FROM t JOIN s ON t.model = s.model AND t.j = s.j GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM c WINDOW w AS (PARTITION BY model, j ORDER BY v)),
ab AS (SELECT a.model, a.j, a.k AS a, b.k AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)::DOUBLE AS m FROM r a JOIN r b ON a.model = b.model AND a.j = b.j AND a.k <= b.k),
mn AS (SELECT i.model, i.j, i.k, i.v, ab.a, min(ab.m) AS m FROM r i JOIN ab ON i.model = ab.model AND i.j = ab.j AND ab.a <= i.k AND ab.b >= i.k GROUP BY ALL),
fit AS (SELECT model, j, v, max(m) AS p FROM mn GROUP BY model, j, v),
x AS (SELECT DISTINCT f.fold AS model, l.j, l.v, l.v * sign AS w FROM l JOIN f ON l.id = f.id JOIN s ON s.model = f.fold AND s.j = l.j),
near AS (
  SELECT x.model, x.j, x.v, x.w, max(fit.v) FILTER (fit.v <= x.w) AS v0, min(fit.v) FILTER (fit.v >= x.w) AS v1, arg_max(fit.p, fit.v) FILTER (fit.v <= x.w) AS p0, arg_min(fit.p, fit.v) FILTER (fit.v >= x.w) AS p1
  FROM x JOIN fit ON x.model = fit.model AND x.j = fit.j GROUP BY x.model, x.j, x.v, x.w),
said AS (SELECT model, j, v, least(greatest(CASE WHEN v0 IS NULL THEN p1 WHEN v1 IS NULL THEN p0 WHEN v1 = v0 THEN p0 ELSE p0 + (p1 - p0) * (w - v0) / (v1 - v0) END, 1e-4), 1 - 1e-4) AS p FROM near)
SELECT l.id, CAST(l.j AS INTEGER) AS j, round(ln(p / (1 - p)), 6) + 0.0 AS evidence FROM l JOIN f ON l.id = f.id JOIN said ON said.model = f.fold AND said.j = l.j AND said.v = l.v""")
def evidence_isotonic(spark, sf_dir):
    """The logit of the isotonic share of class 1 at each coordinate, out of fold."""
    vec = order_vec(spark, sf_dir).withColumn("x", F.array(*[F.col("x")[j] for j in FEW]))
    scored = _out_of_fold(_folded(vec), Isotonic())
    return scored.select("id", F.posexplode("block").alias("j", "v")).select("id", "j", r6(F.col("v")).alias("evidence"))


@query("isotonic_calibrated")
def isotonic_calibrated(spark, sf_dir):
    """Margins of a linear machine turned into probabilities by isotonic regression of the other folds' margins."""
    margins = L.out_of_fold(_folded(order_vec(spark, sf_dir)), LinearSVC(maxIter=20, regParam=0.01), FOLDS)
    scored = _out_of_fold(margins.select("id", "y", "fold", F.array("score").alias("x")), Isotonic(logit=False))
    return scored.select("id", "y", "fold", r6(F.col("x")[0]).alias("margin"), r6(F.col("block")[0]).alias("score"))


STEPS = 20


@query("quantile_places", f"""
WITH {ORDER_VEC}, {TRAIN_SQL},
q AS (SELECT model, j, quantile_cont(v, [{", ".join(str(k / STEPS) for k in range(STEPS + 1))}]) AS q FROM t GROUP BY model, j),
p AS (SELECT l.id, l.j, l.v, q.q, len(list_filter(q.q, lambda e: e < l.v)) AS low, len(list_filter(q.q, lambda e: e <= l.v)) AS upto FROM l JOIN f ON l.id = f.id JOIN q ON q.model = f.fold AND q.j = l.j)
SELECT id, CAST(j AS INTEGER) AS j, round(CASE WHEN low = 0 AND upto = 0 THEN 0.0 WHEN low > {STEPS} THEN {STEPS} WHEN upto > low THEN (low + upto - 1) / 2.0 ELSE low - 1 + (v - q[low]) / (q[low + 1] - q[low]) END / {STEPS}, 6) + 0.0 AS place FROM p""")
def quantile_places(spark, sf_dir):
    """Each coordinate's place among the quantiles of the other folds' rows."""
    scored = _out_of_fold(_folded(order_vec(spark, sf_dir)), E.Quantiles(STEPS))
    return scored.select("id", F.posexplode("block").alias("j", "v")).select("id", "j", r6(F.col("v")).alias("place"))


@query("factor_llr")
def factor_llr(spark, sf_dir):
    """Log densities under factor models of the classes of the other folds, and their difference."""
    rows = _folded(vec_relu(spark, sf_dir)).withColumn("x", V.log1p(F.col("x")))
    scored = _out_of_fold(rows, E.Factors(8))
    return scored.select("id", "fold", *[r6(F.col("block")[i]).alias(n) for i, n in enumerate(("logp0", "logp1", "llr"))])


@query("discriminant_scores")
def discriminant_scores(spark, sf_dir):
    """Decisions of a shrunken linear and a regularised quadratic discriminant, out of fold."""
    scored = _out_of_fold(_folded(vec_relu(spark, sf_dir)).withColumn("x", V.log1p(F.col("x"))), E.Discriminants())
    return scored.select("id", "y", "fold", r6(F.col("block")[0]).alias("lda_score"), r6(F.col("block")[1]).alias("qda_score"))


@query("standardised_pca")
def standardised_pca(spark, sf_dir):
    """Sixteen whitened principal coordinates of standardised logarithms, standardised again; fitted on all rows."""
    rows = _folded(vec_relu(spark, sf_dir)).withColumn("x", V.log1p(F.col("x")))
    steps = [E.Step("z", E.Scaler(), supervised=False), E.Step("pca", E.Projection(16, white=True), ("z",), supervised=False), E.Step("out", E.Scaler(), ("pca",), supervised=False)]
    scored = E.Builder(steps).fit(rows).transform(rows)
    return scored.select("id", F.posexplode("out").alias("k", "v")).select("id", "k", r6(F.col("v")).alias("z"))


FAMILIES = ((tuple(range(8)), None), (tuple(range(8, 32)), 3), (tuple(range(32, 64)), 2))


@query("family_scaling")
def family_scaling(spark, sf_dir):
    """Families of columns as they are or by their whitened principal coordinates, each over the root of its number of coordinates."""
    rows = _folded(vec_relu(spark, sf_dir)).withColumn("x", V.log1p(F.col("x")))
    scored = E.Builder([E.Step("out", E.Projection(families=FAMILIES), supervised=False)]).fit(rows).transform(rows)
    return scored.select("id", F.posexplode("out").alias("k", "v")).select("id", "k", r6(F.col("v")).alias("v"))


@query("staged_history")
def staged_history(spark, sf_dir):
    """AUC on the training and the held-out rows after each stage of boosting, and the gap, for every fold."""
    rows = cut_lineage(_folded(order_vec(spark, sf_dir), 3), "staged-rows")

    def of(fold: int) -> DataFrame:
        train, valid = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = GBTClassifier(maxIter=10, maxDepth=4, seed=1).fit(L.prepared(train))
        return staged.history(model, train, valid).withColumn("fold", F.lit(fold))

    found = reduce(DataFrame.unionByName, side_by_side([partial(of, f) for f in range(3)]))
    return found.select("fold", "stage", *[r6(F.col(c)).alias(c) for c in ("train_auc", "valid_auc", "gap")])


def _columns_tree(rows, method: str):
    """Merges of the 64 columns by their distances over all rows."""
    return hierarchy.merges(hierarchy.column_distances(rows, 64) ** 0.5, method)


@query("column_merges")
def column_merges(spark, sf_dir):
    """The merges of the columns, by Ward's criterion and by mean distance."""
    rows = cut_lineage(vec_relu(spark, sf_dir), "merge-rows")
    found = [(m, k, a, b, round(h, 6), n) for m in ("ward", "average") for k, (a, b, h, n) in enumerate(_columns_tree(rows, m))]
    return spark.createDataFrame(found, "method string, step int, a int, b int, height double, size int")  # two per column


@query("column_agglomeration")
def column_agglomeration(spark, sf_dir):
    """Sixteen means over the columns' clusters, and how often a coordinate exceeds its right neighbour when the columns stand in the tree's order."""
    rows = cut_lineage(vec_relu(spark, sf_dir), "merge-rows")
    tree = _columns_tree(rows, "ward")
    turns = hierarchy.order(tree, 64)
    moved = F.array(*[F.col("x")[j] for j in turns])
    falls = F.size(F.filter(F.zip_with(F.slice(moved, 1, 63), F.slice(moved, 2, 63), lambda a, b: a > b), lambda t: t)).cast("long")
    return rows.select("id", F.transform(hierarchy.agglomerated(F.col("x"), hierarchy.groups(tree, 64, 16)), lambda v: r6(v)).alias("means"), falls.alias("falls"))


@query("learned_group_sort")
def learned_group_sort(spark, sf_dir):
    """Each row's values in order inside the columns' eight clusters, cluster after cluster."""
    rows = cut_lineage(vec_relu(spark, sf_dir), "merge-rows")
    clusters = hierarchy.groups(_columns_tree(rows, "ward"), 64, 8)
    parts = F.concat(*[F.sort_array(F.array(*[F.col("x")[j] for j in c])) for c in clusters])
    return rows.select("id", F.posexplode(parts).alias("k", "v")).select("id", "k", r6(F.col("v")).alias("v"))


COMPONENTS, SPARSITY = 8, 4


@query("sparse_projection", f"""
WITH {VEC_RELU}, d AS (SELECT c, j, CAST('0x' || substr(md5('3:' || c || ':' || j), 1, 4) AS INTEGER) AS d FROM (SELECT unnest(range({COMPONENTS})) AS c), (SELECT unnest(range(64)) AS j)),
s AS (SELECT c, j, CASE WHEN d % {2 * SPARSITY} > 1 THEN 0 WHEN d % 2 = 1 THEN 1 ELSE -1 END AS s FROM d)
SELECT id, CAST(c AS INTEGER) AS k, round(sum(v * s) * sqrt({SPARSITY} / {COMPONENTS}.0), 6) + 0.0 AS v FROM l JOIN s ON l.j = s.j GROUP BY id, c""")
def sparse_projection(spark, sf_dir):
    """Eight sparse random projections with signs by hash."""
    out = hierarchy.projected(F.col("x"), hierarchy.signs(64, COMPONENTS, sparsity=SPARSITY), SPARSITY)
    return vec_relu(spark, sf_dir).select("id", F.posexplode(out).alias("k", "v")).select("id", "k", r6(F.col("v")).alias("v"))


@query("extra_trees_scores")
def extra_trees_scores(spark, sf_dir):
    """Out-of-fold shares of class 1 by extremely randomised trees."""
    rows = cut_lineage(_folded(order_vec(spark, sf_dir), 3), "tree-folds")
    forests = side_by_side([partial(extra_trees.fit, rows.where(F.col("fold") != f), 8, 10, 5) for f in range(3)])
    scored = [rows.where(F.col("fold") == f).select("id", "y", "fold", r6(extra_trees.score(forest, F.col("x"))).alias("score")) for f, forest in enumerate(forests)]
    return reduce(DataFrame.unionByName, scored)


def _trials(spark) -> search.Trials:
    """The table of trials where the session's setting spark.quillstone.trials says; without it, an empty one."""
    return search.Trials(spark, spark.conf.get("spark.quillstone.trials", None) or f"{scratch_root(spark)}/trials-{uuid.uuid4().hex}")


def _logistic(vec, k=3):
    """Evaluates a penalised logistic model: its AUC in every fold of the asked repeats."""
    rows = vec.select("id", "y", V.log1p(F.col("x")).alias("x"))

    def evaluate(settings: dict, repeats) -> DataFrame:
        parts = []
        for r in repeats:
            fold = folds.stratified(rows, k, [SEED + r]).select("id", "fold")
            oof = L.out_of_fold(rows.join(fold, "id"), LogisticRegression(maxIter=10, regParam=settings["penalty"], elasticNetParam=settings["mix"]), k)
            parts.append(feature_auc(oof.select("fold", "y", F.col("score").alias("v")), "fold").select(F.lit(r).alias("repeat"), "fold", "auc"))
        return reduce(DataFrame.unionByName, parts)

    return evaluate


SPACE = {"penalty": [0.001, 0.01, 0.1], "mix": [0.0, 0.5]}


@query("two_stage_search")
def two_stage_search(spark, sf_dir):
    """A grid judged on one repeat, its two best confirmed on three; means, gate and winner."""
    vec = cut_lineage(order_vec(spark, sf_dir), "search-rows")
    found = search.two_stages(_trials(spark), search.grid(SPACE), _logistic(vec), repeats=3, keep=2)
    return found.select("settings", *[r6(F.col(c)).alias(c) for c in ("mean_1", "mean_2", "std_2")], "passes", "best")


@query("randomised_search")
def randomised_search(spark, sf_dir):
    """Four settings drawn by hash, judged on one repeat: all their folds."""
    vec, trials = cut_lineage(order_vec(spark, sf_dir), "search-rows"), _trials(spark)
    chosen = search.drawn(SPACE, 4, 5)
    evaluate = _logistic(vec)
    trials.run("drawn", chosen, lambda s: evaluate(s, [0]))
    table = trials.table().where(F.col("settings").isin([search.key_of(s) for s in chosen]) & (F.col("stage") == "drawn"))
    return table.select("settings", "repeat", "fold", r6(F.col("auc")).alias("auc"))


@query("model_loop")
def model_loop(spark, sf_dir):
    """Three models as they are and refitted without the labels that they doubt: mean AUC over folds, its deviation, rows left out."""
    rows = cut_lineage(_folded(order_vec(spark, sf_dir), 3), "loop-rows")
    models = {"logistic": LogisticRegression(maxIter=10, regParam=0.01), "tree": DecisionTreeClassifier(maxDepth=4, seed=1), "forest": RandomForestClassifier(numTrees=5, maxDepth=4, seed=1)}

    def of(name: str, cleaned: bool) -> DataFrame:
        found = L.by_fold(rows, 3, partial(L.refitted, models[name], cleaned))
        auc = feature_auc(found.select("fold", "y", F.col("score").alias("v")), "fold")
        left = found.groupBy("fold").agg(F.max("left_out").alias("left_out"))
        return auc.join(left, "fold").agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.sum("left_out").alias("left_out")).select(F.lit(name).alias("model"), F.lit(cleaned).alias("cleaned"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "left_out")

    return reduce(DataFrame.unionByName, side_by_side([partial(of, name, cleaned) for name in models for cleaned in (False, True)], 3))


@query("metric_scores")
def metric_scores(spark, sf_dir):
    """A ranker in the learned space: how much nearer a row is to the mean of class 1 than to that of class 0, out of fold."""
    rows = cut_lineage(_folded(vec_relu(spark, sf_dir), 3), "metric-rows")
    made = E.Builder([E.Step("space", Metric(rounds=15)), E.Step("place", E.Centroids(), ("space",))], 3).fit(rows)
    return made.out_of_fold(rows).select("id", "y", "fold", r6(F.col("place")[0]).alias("score"))
