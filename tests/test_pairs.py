"""All pairs of blocks: nothing is shuffled for each pair, and what is found equals a plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import kernels, pairwise

SCHEMA = "id long, x array<double>, y int, fold int"


def table(spark, x, y=None, fold=None):
    rows = [(100 + i, v.tolist(), None if y is None else y[i], None if fold is None else fold[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def points(n=150, p=6):
    rng = np.random.default_rng(3)
    x = np.maximum(rng.standard_normal((n, p)), 0)
    x[:, 0] += 0.1  # no row is zero throughout
    x[20:60] = x[7]
    return x


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_of_blocks_are_not_shuffled(spark):
    df = table(spark, points())
    pairs = pairwise.block_pairs(df, df, size=16)
    assert exchanges(pairs) == 0
    assert pairs.count() == pairs.select("l_b").distinct().count() ** 2 > 50
    assert pairs.groupBy("l_b", "r_b").count().where("count > 1").isEmpty()


def plain(metric, a, b):
    if metric in ("sqeuclidean", "hellinger"):
        r = (lambda v: np.sqrt(v / v.sum(-1, keepdims=True))) if metric == "hellinger" else (lambda v: v)
        return ((r(a)[:, None] - r(b)) ** 2).sum(2)
    if metric == "l1":
        return np.abs(a[:, None] - b).sum(2)
    if metric == "chi2":
        return ((a[:, None] - b) ** 2 / (a[:, None] + b + 1e-10)).sum(2)
    if metric == "hamming":
        return ((a[:, None] > 0) != (b > 0)).mean(2)
    return -np.minimum(a[:, None], b).sum(2) / np.sqrt(a.sum(1)[:, None] * b.sum(1))


@pytest.mark.parametrize("metric", ["sqeuclidean", "l1", "chi2", "hellinger", "hamming", "intersection"])
def test_nearest_rows_with_many_copies(spark, metric):
    x = points()
    d = plain(metric, x, x)
    np.fill_diagonal(d, np.inf)
    got = {(r.id - 100, r["rank"]): (r.other - 100, r.d) for r in pairwise.neighbours(*[table(spark, x)] * 2, metric, 4, size=16).collect()}
    assert len(got) == 4 * len(x)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i].round(12)))[:4]
        assert [got[i, k][1] for k in range(1, 5)] == pytest.approx(d[i, order].tolist(), abs=1e-12)
        if metric != "intersection":  # sums of a quotient differ in the last place
            assert [got[i, k][0] for k in range(1, 5)] == order.tolist()


def test_values_without_a_distance_are_no_neighbours(spark):
    x = points(40)
    x[3, 1], x[4, 2] = np.inf, np.nan
    got = pairwise.neighbours(*[table(spark, x)] * 2, "sqeuclidean", 39, size=8).collect()
    assert len(got) == 38 * 37 and not {103, 104} & {r.id for r in got} and not {103, 104} & {r.other for r in got}


def test_neighbours_of_each_class_keep_folds_apart(spark):
    x, rng = points(), np.random.default_rng(5)
    y, fold = rng.integers(0, 2, len(x)).tolist(), rng.integers(0, 3, len(x)).tolist()
    df, d = table(spark, x, y, fold), plain("sqeuclidean", x, x)
    for left, apart in ((df, True), (df.withColumn("fold", F.lit(None).cast("int")), False)):
        got = {(r.id - 100, r.y, r["rank"]): r.other - 100 for r in pairwise.class_neighbours(left, df, "sqeuclidean", 5, size=16).collect()}
        for i in range(len(x)):
            for c in (0, 1):
                own = [j for j in np.lexsort((np.arange(len(x)), d[i])) if y[j] == c and not (apart and fold[j] == fold[i])][:5]
                assert [got[i, c, k] for k in range(1, 6)] == own


def test_left_rows_beyond_what_a_task_holds(spark):
    x = points()
    df, d = table(spark, x), plain("sqeuclidean", x, x)
    meet = lambda results, l, r: results.setdefault((), pairwise.Nearest(l.id, 3)).meet("sqeuclidean", l.x, r.x, r.id, None)
    found = pairwise._nearest(df, df, 8, (), "id long, other long, d double", meet, held_rows=20).orderBy("id", "d").collect()
    least: dict[int, list[float]] = {}
    for r in found:
        least.setdefault(r.id - 100, []).append(r.d)
    assert len(least) == len(x) and all(sorted(v)[:3] == pytest.approx(np.sort(d[i])[:3], abs=1e-12) for i, v in least.items())


def test_only_asked_kernels_are_evaluated(spark):
    x = points(60)
    df = table(spark, x)
    algebra = {"a": kernels.Rbf(kernels.Leaf(0, 6), 0.4), "b": kernels.Product((kernels.Name("a"), kernels.Rbf(kernels.Leaf(0, 3), 0.2)))}
    whole = kernels.report(df, df, algebra, size=16)
    d, d3 = plain("sqeuclidean", x, x), plain("sqeuclidean", x[:, :3], x[:, :3])
    want = {"a": np.exp(-0.4 * d).sum(1), "b": np.exp(-0.4 * d - 0.2 * d3).sum(1)}
    for r in whole.rows.collect():
        assert r.total == pytest.approx(want[r.kernel][r.id - 100]) and r.diagonal == pytest.approx(1)
    for r in whole.checks.collect():
        assert (r.pairs, r.finite, r.symmetric, r.positive, r.unit) == (3600, True, True, True, True)
    assert {r.kernel for r in kernels.report(df, df, algebra, size=16, asked=("b",)).rows.select("kernel").distinct().collect()} == {"b"}


def test_search_moves_only_what_it_found(spark):
    from quillstone.llm import ann

    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(df, block=256)
    got = ann.search(index, df.where("vec_id % 100 = 0"), k=5, query_block=8)
    assert exchanges(got) == 1  # the ranking of each query
    for r in got.collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        assert np.argsort(d, kind="stable")[r["rank"] - 1] == r.vec_id and r.score == pytest.approx(d[r.vec_id])
