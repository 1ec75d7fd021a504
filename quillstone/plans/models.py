"""Fitted models: Gaussian geometry, kernel machines on random features, trees, stacking, calibration, noise and drift."""

from __future__ import annotations

from functools import partial, reduce

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import r6
from ..operators import copula, folds
from ..operators import estimators as E
from ..operators import gaussian as G
from ..operators import learners as L
from ..operators.comparison import ranked
from ..operators.graph import cut_lineage
from ..operators.ranks import feature_auc
from ..operators.parallel import side_by_side
from ..sources.fixtures import VEC_RELU, order_vec, part_vec, vec_relu
from .register import query

FOLDS, SEED = 3, 11
PARTS = [(0, 32, 0.6, 0.5), (32, 64, 0.4, 1.2)]


def _folded(vec, k=FOLDS):
    """id, y, fold and x with logarithms taken."""
    fold = folds.stratified(vec, k, [SEED]).select("id", "fold")
    return vec.join(fold, "id").select("id", "y", "fold", V.log1p(F.col("x")).alias("x"))


def _models(rows, k=FOLDS):
    """Rows once for each model that may see them."""
    return rows.withColumn("model", F.explode(F.array_compact(F.array(*[F.when(F.col("fold") != f, F.lit(f)) for f in range(k)]))))


def _scores(df):
    return df.select("id", "y", "fold", r6(F.col("score")).alias("score"))


@query("ledoit_wolf", f"""
WITH {VEC_RELU}, z AS (SELECT y, id, j, v - avg(v) OVER (PARTITION BY y, j) AS z FROM l),
f AS (SELECT y, count(*) AS n, avg(q * q) AS fourth FROM (SELECT y, id, sum(z * z) AS q FROM z GROUP BY y, id) GROUP BY y),
c AS (SELECT a.y, a.j AS a, b.j AS b, avg(a.z * b.z) AS s FROM z a JOIN z b ON a.id = b.id GROUP BY a.y, a.j, b.j),
s AS (SELECT y, sum(s * s) AS norm, sum(s) FILTER (a = b) AS trace, 64 AS p FROM c GROUP BY y)
SELECT f.y, CAST(n AS BIGINT) AS n, round(trace / p, 6) AS mu, round(least((fourth - norm) / (p * n), (norm - trace * trace / p) / p) / ((norm - trace * trace / p) / p), 6) AS shrinkage FROM f JOIN s ON f.y = s.y""")
def ledoit_wolf(spark, sf_dir):
    """Shrinkage of the covariance of each class."""
    train = vec_relu(spark, sf_dir).withColumn("model", F.lit(0))
    found = G.shrinkage(train, G.moments(train, 64))
    rows = spark.createDataFrame([(y, n, float(mu), float(w)) for (_, y), (n, mu, w) in found.items()], "y int, n long, mu double, shrinkage double")
    return rows.select("y", "n", r6(F.col("mu")).alias("mu"), r6(F.col("shrinkage")).alias("shrinkage"))


def _states(train, p=64):
    found = G.moments(train, p)
    weights = G.shrinkage(train, found)
    every = {(m, -1): G.together(found, m) for m in {m for m, _ in found}}
    of_all = G.shrinkage(train.withColumn("y", F.lit(-1)), every)
    states = {}
    for model in sorted({m for m, _ in found}):
        n, mean, cov = zip(*(found[model, y] for y in (0, 1)))
        states[model] = G.class_state(list(n), list(mean), list(cov), [weights[model, y][2] for y in (0, 1)], G.shrunk(every[model, -1][2], of_all[model, -1][2]))
    return states


@query("gaussian_features_oof")
def gaussian_features_oof(spark, sf_dir):
    """LDA, QDA, Mahalanobis, RDA, PPCA and subspace scores of each row under the model of the other folds."""
    rows = _folded(vec_relu(spark, sf_dir))
    found = G.score_rows(rows.withColumn("model", F.col("fold")), _states(_models(rows)))
    return found.select("id", F.col("model").alias("fold"), "name", r6(F.col("value")).alias("value"))


@query("lda_qda_auc")
def lda_qda_auc(spark, sf_dir):
    """AUC of every Gaussian feature over the out-of-fold rows."""
    rows = _folded(vec_relu(spark, sf_dir))
    found = G.score_rows(rows.withColumn("model", F.col("fold")), _states(_models(rows)))
    joined = found.join(rows.select("id", "y"), "id").select("name", "y", F.col("value").alias("v"))
    return feature_auc(joined, "name").select("name", r6(F.col("auc")).alias("auc"))


@query("pca_whiten")
def pca_whiten(spark, sf_dir):
    """Sixteen whitened principal coordinates of the logarithms."""
    rows = _folded(vec_relu(spark, sf_dir))
    _, mean, cov = G.moments(rows.select(F.lit(0).alias("model"), F.lit(0).alias("y"), "x"), 64)[0, 0]
    z = G.whiten(rows, mean, cov, 16)
    return z.select("id", F.posexplode("z").alias("k", "z")).select("id", "k", r6(F.col("z")).alias("z"))


@query("pca_spectrum")
def pca_spectrum(spark, sf_dir):
    """Explained variance of the principal directions and its running sum."""
    import numpy as np

    rows = _folded(vec_relu(spark, sf_dir))
    _, _, cov = G.moments(rows.select(F.lit(0).alias("model"), F.lit(0).alias("y"), "x"), 64)[0, 0]
    share = G.floored(cov)[0] / G.floored(cov)[0].sum()
    return spark.createDataFrame([(k, round(float(s), 6), round(float(c), 6)) for k, (s, c) in enumerate(zip(share, np.cumsum(share)), 1)], "k int, share double, running double")


@query("copula_llr")
def copula_llr(spark, sf_dir):
    """Log densities of the class copulas of the other folds, their difference, that of the binned marginals, and both together."""
    vec = vec_relu(spark, sf_dir)
    fold = folds.stratified(vec, FOLDS, [SEED]).select("id", "fold")
    rows = cut_lineage(vec.join(fold, "id").select("id", "y", "fold", "x"), "copula-vectors")
    found = copula.scores(rows.select("id", "y", "fold", F.posexplode("x").alias("j", "v")), FOLDS, 64)
    marginals = E.Builder([E.Step("m", E.Evidence())], FOLDS).fit(rows).out_of_fold(rows).select("id", F.col("m")[0].alias("m"))
    llr = F.col("logp1") - F.col("logp0")
    return found.join(marginals, "id").select("id", F.col("model").alias("fold"), *[r6(F.col(c)).alias(c) for c in ("logp0", "logp1")], r6(llr).alias("llr"), r6(F.col("m")).alias("marginal_llr"), r6(llr + F.col("m")).alias("joint_llr"))


@query("mixture_components")
def mixture_components(spark, sf_dir):
    """Log densities of each row under class mixtures of three Gaussians of the other folds, and their difference."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = cut_lineage(_folded(cut_lineage(order_vec(spark, sf_dir), "order-vectors")), "fold-rows")  # fits read them many times

    def fitted(f: int) -> list:
        train = rows.where(F.col("fold") != f)
        return [L.mixture_state(GaussianMixture(k=3, seed=1, maxIter=10).fit(train.where(F.col("y") == y).select(array_to_vector("x").alias("features")))) for y in (0, 1)]

    found = L.fold_densities(rows, side_by_side([partial(fitted, f) for f in range(FOLDS)]), ["logp0", "logp1"])
    return found.select("id", "fold", *[r6(F.col(c)).alias(c) for c in ("logp0", "logp1")], r6(F.col("logp1") - F.col("logp0")).alias("llr"))


@query("logistic_grid")
def logistic_grid(spark, sf_dir):
    """A grid of penalties: mean AUC over folds, the best marked; ties to the stronger penalty."""
    rows, out = _folded(order_vec(spark, sf_dir)), None
    for c in (0.001, 0.01, 0.1):
        oof = L.out_of_fold(rows, LogisticRegression(maxIter=15, regParam=c), FOLDS)
        part = feature_auc(oof.select("fold", "y", F.col("score").alias("v")), "fold").agg(F.avg("auc").alias("cv")).select(F.lit(c).alias("penalty"), "cv")
        out = part if out is None else out.unionByName(part)
    best = F.broadcast(out.agg(F.max_by("penalty", F.struct(F.round("cv", 9), F.col("penalty"))).alias("best")))  # one row
    return out.join(best).select("penalty", r6(F.col("cv")).alias("cv"), (F.col("penalty") == F.col("best")).alias("best"))


@query("svc_oof")
def svc_oof(spark, sf_dir):
    """Out-of-fold margins of an RBF machine on random features."""
    rows = L.fourier(_folded(vec_relu(spark, sf_dir)), [(0, 64, 1.0, 0.8)])
    return _scores(L.out_of_fold(rows, LinearSVC(maxIter=30, regParam=0.01), FOLDS))


@query("multi_kernel_oof")
def multi_kernel_oof(spark, sf_dir):
    """The same with a weighted sum of two kernels over blocks of columns."""
    rows = L.fourier(_folded(vec_relu(spark, sf_dir)), PARTS)
    return _scores(L.out_of_fold(rows, LinearSVC(maxIter=30, regParam=0.01), FOLDS))


@query("swap_augmented_svc")
def swap_augmented_svc(spark, sf_dir):
    """A machine fitted on the other folds' rows and their halves swapped."""

    def scored(train, held):
        both, held = (L.prepared(L.fourier(r, [(0, 64, 1.0, 0.8)])) for r in (train.unionByName(train.withColumn("x", V.swap_halves(F.col("x")))), held))
        return L.positive(LinearSVC(maxIter=30, regParam=0.01).fit(both).transform(held))

    return _scores(L.by_fold(_folded(vec_relu(spark, sf_dir)), FOLDS, scored))


def _trees(name, estimator, doc):
    @query(name)
    def run(spark, sf_dir):
        return _scores(L.out_of_fold(_folded(order_vec(spark, sf_dir)), estimator(), FOLDS))

    run.__doc__ = doc


_trees("tree_scores", lambda: DecisionTreeClassifier(maxDepth=5, seed=1), "Out-of-fold probabilities of a decision tree.")
_trees("forest_scores", lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=1), "The same of a random forest.")
_trees("logistic_scores", lambda: LogisticRegression(maxIter=20, regParam=0.01), "The same of a logistic model.")
_trees("mlp_scores", lambda: MultilayerPerceptronClassifier(layers=[8, 16, 2], maxIter=30, seed=1), "The same of a network with one hidden layer.")


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Boosted trees that stop early on a fifth of the training rows, by hash."""
    rows = _folded(order_vec(spark, sf_dir)).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    trees = GBTClassifier(maxIter=10, maxDepth=4, seed=1, validationIndicatorCol="held", validationTol=0.001)
    return _scores(L.by_fold(rows, FOLDS, lambda train, held: L.positive(trees.fit(L.prepared(train)).transform(L.prepared(held)))))


def _base_scores(spark, sf_dir):
    rows = _folded(order_vec(spark, sf_dir))
    bases = {"tree": DecisionTreeClassifier(maxDepth=4, seed=1), "forest": RandomForestClassifier(numTrees=10, maxDepth=5, seed=1), "logistic": LogisticRegression(maxIter=15, regParam=0.01)}
    out = None
    for name, estimator in bases.items():
        part = L.out_of_fold(rows, estimator, FOLDS).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("stacking")
def stacking(spark, sf_dir):
    """A logistic model over the out-of-fold probabilities of three bases."""
    scores = _base_scores(spark, sf_dir).groupBy("id", "y", "fold").agg(F.array_sort(F.collect_list(F.struct("model", "score"))).alias("s")).select("id", "y", "fold", F.col("s.score").alias("x"))  # three scores
    return _scores(L.out_of_fold(scores, LogisticRegression(maxIter=20), FOLDS))


@query("calibrated")
def calibrated(spark, sf_dir):
    """Margins turned into probabilities by a logistic model of one feature."""
    margins = L.out_of_fold(_folded(order_vec(spark, sf_dir)), LinearSVC(maxIter=20, regParam=0.01), FOLDS)
    return _scores(L.out_of_fold(margins.select("id", "y", "fold", F.array("score").alias("x")), LogisticRegression(maxIter=20), FOLDS))


@query("bagged")
def bagged(spark, sf_dir):
    """Mean probability of five members fitted on rows drawn with replacement from the other folds."""

    members = 5

    def scored(train, held):
        each = []
        for m in range(members):
            drawn = L.prepared(train.withColumn("w", F.col("draws")[m].cast("double")).where("w > 0"))
            fitted = LogisticRegression(maxIter=15, regParam=0.01, weightCol="w").fit(drawn)
            each.append(V.sigmoid(V.dot(F.col("x"), F.array(*map(F.lit, fitted.coefficients.toArray().tolist()))) + fitted.intercept))
        return held.select("id", "y", (sum(each) / members).alias("score"))

    rows = _folded(order_vec(spark, sf_dir))
    return _scores(L.by_fold(rows.withColumn("draws", F.array(*[folds.draws(3, m) for m in range(members)])), FOLDS, scored))


@query("ranker")
def ranker(spark, sf_dir):
    """A pairwise logistic ranker: fitted on differences of the other folds' rows, applied to rows."""
    model = LogisticRegression(maxIter=20, regParam=0.01, fitIntercept=False)
    return _scores(L.by_fold(_folded(order_vec(spark, sf_dir)), FOLDS, lambda train, held: L.positive(model.fit(L.prepared(L.pair_differences(train))).transform(L.prepared(held)))))


@query("label_noise_candidates")
def label_noise_candidates(spark, sf_dir):
    """Rows whose label the out-of-fold probabilities contradict."""
    found = L.noisy_labels(L.out_of_fold(_folded(order_vec(spark, sf_dir)), LogisticRegression(maxIter=20, regParam=0.01), FOLDS))
    return found.select("id", "y", r6(F.col("score")).alias("score"))


@query("adversarial_auc")
def adversarial_auc(spark, sf_dir):
    """AUC of a forest that tells two halves of the table apart: about one half without drift."""
    vec = order_vec(spark, sf_dir).withColumn("y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    oof = L.out_of_fold(_folded(vec), RandomForestClassifier(numTrees=10, maxDepth=4, seed=1), FOLDS)
    return feature_auc(oof.select(F.lit("train vs test").alias("name"), "y", F.col("score").alias("v")), "name").select("name", r6(F.col("auc")).alias("auc"))


@query("adversarial_tables")
def adversarial_tables(spark, sf_dir):
    """A forest that tells the vectors of orders from those of parts: AUC over all out-of-fold rows, and each column's mean importance over the folds."""
    both = order_vec(spark, sf_dir).select("id", "x", F.lit(0).alias("y")).unionByName(part_vec(spark, sf_dir).select((-F.col("id") - 1).alias("id"), "x", F.lit(1).alias("y")))
    rows = L.prepared(cut_lineage(_folded(both), "two-tables"))
    models = side_by_side([partial(RandomForestClassifier(numTrees=10, maxDepth=4, seed=1).fit, rows.where(F.col("fold") != f)) for f in range(FOLDS)])
    scored = reduce(DataFrame.unionByName, [L.positive(m.transform(rows.where(F.col("fold") == f))) for f, m in enumerate(models)])
    importance = sum(m.featureImportances.toArray() for m in models) / FOLDS
    found = spark.createDataFrame([(j, round(float(v), 6)) for j, v in enumerate(importance)], "j int, importance double")  # a row per column
    auc = feature_auc(scored.select(F.lit(1).alias("all"), "y", F.col("score").alias("v")), "all").select(r6(F.col("auc")).alias("auc"))
    return found.join(F.broadcast(auc))


@query("final_blend")
def final_blend(spark, sf_dir):
    """Ranks of three models' scores, blended .4/.4/.2 and ranked again: a score in (0, 1] for every row."""
    weight = F.create_map(*[F.lit(x) for x in ("forest", 0.4, "logistic", 0.4, "tree", 0.2)])
    r = ranked(_base_scores(spark, sf_dir), "model")
    blend = r.groupBy("id", "y").agg(F.round(F.sum(F.element_at(weight, F.col("model")) * F.col("r")), 9).alias("score")).withColumn("all", F.lit(1))
    return ranked(blend, "all").select("id", "y", r6(F.col("r")).alias("score"))
