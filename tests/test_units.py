"""Edge cases and identities of the building blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import coordinates, folds, gaussian, learners, pairwise
from quillstone.operators.comparison import normalized, wilcoxon_p
from quillstone.operators.graph import components
from quillstone.operators.ranks import average_rank_by_counts, feature_auc, global_rank, quantiles
from quillstone.sources import files


def vec(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def test_auc_with_ties_constant_and_one_class(spark):
    rows = [(0, s, y) for s, y in zip([1, 1, 1, 2, 2, 3, 0], [0, 1, 1, 0, 1, 1, 0])] + [(1, 5, y) for y in (0, 1, 1)] + [(2, s, 1) for s in (1, 2)]
    got = {r.j: r.auc for r in feature_auc(spark.createDataFrame([(j, float(s), y) for j, s, y in rows], "j int, v double, y int"), "j").collect()}
    assert got[0] == pytest.approx(0.7083333333) and got[1] == 0.5 and got[2] == 0.5


def test_row_functions_on_zero_and_odd_vectors(spark):
    df = vec(spark, [(1, [0.0, 0.0, 0.0], 0), (2, [3.0, 1.0, 2.0], 1)])
    got = {r.id: r for r in df.select("id", V.mean(F.col("x")).alias("m"), V.scaled(F.col("x"), V.norm(F.col("x"), 1)).alias("s"), V.swap_halves(F.col("x")).alias("h"), V.mask(F.col("x")).alias("k")).collect()}
    assert got[1].m == 0 and got[1].s == [0, 0, 0] and got[1].k == "000"
    assert got[2].h == [1.0, 3.0, 2.0] and got[2].k == "111"


def test_block_sort_refuses_other_lengths(spark):
    with pytest.raises(Exception, match="not divisible"):
        vec(spark, [(1, [1.0, 2.0, 3.0], 0)]).select(V.block_sort(F.col("x"), 2)).collect()


def test_quantiles_and_ranks_match_numpy(spark):
    random.seed(1)
    values = [random.choice([0.0, random.random()]) for _ in range(300)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    for r in quantiles(df, [0.0, 0.1, 0.5, 0.9, 1.0], "g").collect():
        assert r.q == pytest.approx(list(np.quantile(values[r.g :: 2], [0, 0.1, 0.5, 0.9, 1])))
    ranks = {r.v: r["rank"] for r in average_rank_by_counts(df.where("g = 0"), "v", "g").collect()}
    own = sorted(values[::2])
    for v, k in ranks.items():
        places = [i + 1 for i, o in enumerate(own) if o == v]
        assert k == sum(places) / len(places)


def test_global_rank_is_gapless(spark):
    ids = random.sample(range(10**6), 500)
    got = global_rank(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "k").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.k)] == sorted(ids) and sorted(r.k for r in got) == list(range(500))


def test_folds_are_balanced_and_stable(spark):
    df = vec(spark, [(i, [0.0], int(i % 3 == 0)) for i in range(100)])
    a = {(r.id): r.fold for r in folds.stratified(df, 5, [11]).collect()}
    b = {(r.id): r.fold for r in folds.stratified(df.repartition(7), 5, [11]).collect()}
    assert a == b
    for y in (0, 1):
        sizes = [sum(1 for i, f in a.items() if f == k and int(i % 3 == 0) == y) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_own_label_never_changes_own_score(spark):
    def run(flip):
        rows = [(i, float(i % 7), int((i % 2 == 0) != (i == flip)), i % 5) for i in range(60)]
        long = spark.createDataFrame([(i, y, f, 0, v) for i, v, y, f in rows], "id long, y int, fold int, j int, v double")
        train = coordinates.training(long, 5)
        edges = coordinates.fit_edges(train, 4)
        table = coordinates.fit_ratios(train, edges, 5.0)
        return {r.id: r.llr for r in coordinates.score(long.select("id", F.col("fold").alias("model"), "j", "v"), edges, table).collect()}

    assert run(None)[13] == run(13)[13]


def test_isotonic_fit_is_pool_adjacent_violators(spark):
    random.seed(4)
    w, v = [random.randint(1, 9) for _ in range(8)], [random.gauss(0, 1) for _ in range(8)]
    blocks = []
    for a, b in zip(v, w):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y = blocks.pop()
            x = blocks.pop()
            blocks.append([(x[0] * x[1] + y[0] * y[1]) / (x[1] + y[1]), x[1] + y[1], x[2] + y[2]])
    want = [b[0] for b in blocks for _ in range(b[2])]
    table = spark.createDataFrame([(0, 0, i, a, 0, b) for i, (a, b) in enumerate(zip(w, v))], "model int, j int, bin int, c0 long, c1 long, llr double")
    up = spark.createDataFrame([(0, 0, True)], "model int, j int, up boolean")
    got = [r.llr for r in coordinates.isotonic(table, up).orderBy("bin").collect()]
    assert got == pytest.approx(want)


def test_neighbours_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.random((90, 5))
    x[50] = x[3]
    df = vec(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)])
    got = pairwise.neighbours(df, df, "sqeuclidean", 3, size=16).collect()
    for r in got:
        d = ((x - x[r.id]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(90), d)) if j != r.id]
        assert order[r["rank"] - 1] == r.other
    assert len(got) == 270


def test_components_of_a_path_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))


def test_shrinkage_matches_its_definition(spark):
    rng = np.random.default_rng(3)
    x = rng.random((40, 4))
    z = x - x.mean(0)
    s = z.T @ z / 40
    mu = np.trace(s) / 4
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 40**2 / 4
    delta = ((s - mu * np.eye(4)) ** 2).sum() / 4
    train = spark.createDataFrame([(0, 0, r.tolist()) for r in x], "model int, y int, x array<double>")
    n, mean, cov = gaussian.moments(train, 4)[0, 0]
    assert n == 40 and np.allclose(mean, x.mean(0)) and np.allclose(cov, s)
    _, mu_got, weight = gaussian.shrinkage(train, {(0, 0): (n, mean, cov)})[0, 0]
    assert weight == pytest.approx(min(beta, delta) / delta) and mu_got == pytest.approx(mu)
    far = spark.createDataFrame([(0, 0, (r + 1e9).tolist()) for r in x], "model int, y int, x array<double>")
    assert np.allclose(gaussian.moments(far, 4)[0, 0][2], s, atol=1e-6)


def test_moments_of_classes_add_up():
    x, y = np.random.default_rng(2).random((50, 3)), np.arange(50) % 3 == 0
    found = {(0, c): (int((y == c).sum()), x[y == c].mean(0), np.cov(x[y == c].T, ddof=0)) for c in (0, 1)}
    n, mean, cov = gaussian.together(found, 0)
    assert n == 50 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, ddof=0))


def test_gaussian_features_equal_their_definitions():
    rng = np.random.default_rng(5)
    x = [rng.random((60, 4)), rng.random((50, 4)) + 0.3]
    cov, mean = [np.cov(v.T, ddof=0) for v in x], [v.mean(0) for v in x]
    every = np.cov(np.concatenate(x).T, ddof=0)
    own = [gaussian.shrunk(c, 0.2) for c in cov]
    got = gaussian.scores(z := rng.random((7, 4)), gaussian.class_state([60, 50], mean, cov, [0.2, 0.2], every))
    squared = lambda m, c: np.array([(r - m) @ np.linalg.inv(c) @ (r - m) for r in z])
    d = [squared(m, c) for m, c in zip(mean, own)]
    assert np.allclose(got["mahal_sq_0"], d[0]) and np.allclose(got["mahal_norm_diff"], (d[0] - d[1]) / (d[0] + d[1]))
    qda = [-0.5 * (q + np.linalg.slogdet(c)[1]) + np.log(n / 110) for q, c, n in zip(d, own, (60, 50))]
    assert np.allclose(got["qda"], qda[1] - qda[0])
    r = [squared(m, 0.75 * every + 0.25 * c) for m, c in zip(mean, own)]
    assert np.allclose(got["rda_0.25"], r[0] - r[1]) and np.allclose(got["rda_norm_0.25"], (r[0] - r[1]) / (r[0] + r[1]))
    w, c = mean[1] - mean[0], z - (mean[0] + mean[1]) / 2
    axis = c @ w / np.linalg.norm(w)
    off = np.linalg.norm(c - np.outer(axis, w / np.linalg.norm(w)), axis=1)
    assert np.allclose(got["mid_axis"], axis) and np.allclose(got["mid_orth"], off) and np.allclose(got["mid_axis_snr"], axis / (off / 3**0.5))
    value, vector = np.linalg.eigh(every)
    root = vector / np.sqrt(value) @ vector.T
    f = root @ w / np.linalg.norm(root @ w)
    assert np.allclose(got["fisher_axis"], c @ root @ f) and np.allclose(got["fisher_cos"], c @ root @ f / np.linalg.norm(c @ root, axis=1))
    logp = []
    for m, s in zip(mean, cov):
        value, vector = np.linalg.eigh(s)
        full = vector[:, -2:] * value[-2:] @ vector[:, -2:].T + value[:2].mean() * vector[:, :2] @ vector[:, :2].T
        logp.append(-0.5 * (squared(m, full) + np.linalg.slogdet(2 * np.pi * full)[1]))
    assert np.allclose(got["ppca_logp0_2"], logp[0]) and np.allclose(got["ppca_llr_2"], logp[1] - logp[0])
    left = [np.linalg.norm((z - m) @ np.linalg.eigh(s)[1][:, :2], axis=1) for m, s in zip(mean, cov)]
    assert np.allclose(got["subspace_diff_2"], left[0] - left[1])


def test_copulas_equal_their_definition(spark):
    from statistics import NormalDist

    from quillstone.operators import copula

    rng = np.random.default_rng(6)
    x, y, fold = np.maximum(rng.normal(size=(60, 3)), 0).round(2), np.arange(60) % 2, np.arange(60) // 2 % 3
    long = spark.createDataFrame([(i, int(y[i]), int(fold[i]), j, float(x[i, j])) for i in range(60) for j in range(3)], "id long, y int, fold int, j int, v double")
    got = {r.id: (r.logp0, r.logp1) for r in copula.scores(long, 3, 3).collect()}

    def normal(values, own):
        u = np.array([[(np.sort(own[:, j]).searchsorted(v[j], "right") + 0.5) / (len(own) + 1) for j in range(3)] for v in values])
        return np.vectorize(NormalDist().inv_cdf)(np.clip(u, 1e-4, 1 - 1e-4))

    for f in range(3):
        held = np.flatnonzero(fold == f)
        for c in (0, 1):
            own = x[(fold != f) & (y == c)]
            z = normal(own, own)
            cov = np.cov(z.T, ddof=0)
            n, p, centred = len(z), 3, z - z.mean(0)
            norm, trace = (cov * cov).sum(), np.trace(cov)
            beta, delta = (np.mean((centred**2).sum(1) ** 2) - norm) / (p * n), (norm - trace**2 / p) / p
            s = gaussian.shrunk(cov, min(beta, delta) / delta)
            t = normal(x[held], own)
            want = -0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", t, np.linalg.inv(s), t) - (t * t).sum(1))
            assert np.allclose([got[i][c] for i in held], want)


def test_whitened_coordinates_have_unit_covariance(spark):
    rng = np.random.default_rng(5)
    x = rng.random((80, 4)) @ rng.random((4, 4))
    df = vec(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)])
    z = np.array([r.z for r in gaussian.whiten(df, x.mean(0), np.cov(x.T, ddof=0), 3).collect()])
    assert np.allclose(np.cov(z.T, ddof=0), np.eye(3), atol=1e-6)


def test_random_features_approach_the_kernel(spark):
    rng = np.random.default_rng(6)
    x = rng.random((20, 4))
    df = vec(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)])
    z = np.array([r.x for r in learners.fourier(df, [(0, 2, 0.6, 0.5), (2, 4, 0.4, 1.2)], 8192).orderBy("id").collect()])
    d = lambda a, b: ((x[:, None, a:b] - x[None, :, a:b]) ** 2).sum(2)
    assert np.abs(z @ z.T - 0.6 * np.exp(-0.5 * d(0, 2)) - 0.4 * np.exp(-1.2 * d(2, 4))).max() < 0.05


def test_weights_are_checked(spark):
    with pytest.raises(Exception, match="not usable"):
        normalized(spark.createDataFrame([("a", 0, -1.0), ("a", 1, 2.0)], "name string, model int, weight double")).collect()


def test_signed_rank_probabilities():
    assert wilcoxon_p(0, 5) == pytest.approx(0.0625) and wilcoxon_p(7.5, 5) == 1.0 and wilcoxon_p(0, 0) == 1.0


def test_submission_contract(spark, tmp_path):
    sample = spark.createDataFrame([(2, 0), (1, 1)], "id long, pos long")
    good = spark.createDataFrame([(1, 0.25), (2, 1.0)], "id long, score double")
    files.write_submission(files.submission(sample, good), str(tmp_path / "out"))
    assert [(r.row_id, r.target) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] in ([("2", "1.0"), ("1", "0.25")], [("1", "0.25"), ("2", "1.0")])
    for bad in ([(1, 0.25)], [(1, 0.25), (2, 1.5)], [(1, 0.25), (1, 0.25), (2, 0.5)], [(1, math.nan), (2, 0.5)]):
        with pytest.raises(Exception):
            files.submission(sample, spark.createDataFrame(bad, "id long, score double")).collect()


def test_csv_source_checks_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("row_id,f0,f1,target\na,1.0,2.0,1\nb,0.0,3.5,0\n")
    got = files.read_vectors(spark, str(tmp_path / "a.csv"), ["f0", "f1"]).orderBy("id").collect()
    assert [(r.id, r.x, r.y) for r in got] == [("a", [1.0, 2.0], 1), ("b", [0.0, 3.5], 0)]
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "a.csv"), ["f1", "f0"])


def test_quality_report_counts_every_fault(spark):
    r = files.quality_report(spark.createDataFrame([(1, [1.0, None], 0), (1, [math.nan, -1.0], 2), (2, [math.inf, 0.0], 1)], "id long, x array<double>, y int")).first()
    assert (r.n_rows, r.distinct_ids, r.nulls, r.nans, r.infinite, r.negative, r.odd_labels) == (3, 2, 1, 1, 1, 1, 1)


def test_cache_builds_once_and_refuses_what_is_missing(spark, tmp_path):
    from quillstone.sources.cache import TableCache

    cache, calls = TableCache(spark, f"file://{tmp_path}"), []

    def build():
        calls.append(1)
        return spark.range(5)

    assert cache.get("folds", {"seed": 1, "k": 5}, build).count() == cache.get("folds", {"k": 5, "seed": 1}, build).count() == 5
    assert len(calls) == 1 and cache.load("folds", {"seed": 1, "k": 5}).count() == 5
    with pytest.raises(LookupError):
        cache.load("folds", {"seed": 2, "k": 5})


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    from quillstone.streaming.scoring import score_stream

    rng = np.random.default_rng(7)
    x = rng.random((30, 4))
    states = {0: gaussian.class_state([15, 15], [x[:15].mean(0), x[15:].mean(0)], [np.cov(x[:15].T, ddof=0), np.cov(x[15:].T, ddof=0)], [0.1, 0.1], np.cov(x.T, ddof=0))}
    rows = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id long, model int, x array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, states).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.id, r.name, round(r.value, 9)) for r in df.collect())
    assert key(spark.table("scored")) == key(gaussian.score_rows(rows, states))
