"""Estimators, stores, kernels, group folds, isotonic fits, stages and hierarchies against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import estimators as E
from quillstone.operators import folds, hierarchy, isotonic, kernels, staged
from quillstone.operators import gaussian as G
from quillstone.sources.models import ModelStore


def labelled(spark, n=90, p=6, k=3, seed=1):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = np.maximum(rng.standard_normal((n, p)) + y[:, None] * np.linspace(0, 1, p), 0)
    fold = np.arange(n) // 2 % k
    rows = [(i, int(y[i]), int(fold[i]), x[i].tolist()) for i in range(n)]
    return x, y, fold, spark.createDataFrame(rows, "id long, y int, fold int, x array<double>")


def blocks(df, to="out"):
    return np.array([r[to] for r in df.orderBy("id").collect()])


def other_rows(spark, p=6, seed=9):
    x = np.maximum(np.random.default_rng(seed).standard_normal((20, p)), 0)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def both_ways(spark, estimator, define, n=90, p=6):
    """The block of the training rows and of other rows, and what `define(x, y, at)` says of rows `at` from training rows x, y."""
    x, y, fold, rows = labelled(spark, n, p)
    made = E.Builder([E.Step("out", estimator)], 3).fit(rows)
    got = blocks(made.out_of_fold(rows))
    want = np.empty_like(got)
    for f in range(3):
        want[fold == f] = define(x[fold != f], y[fold != f], x[fold == f])
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-7)
    u, others = other_rows(spark, p)
    np.testing.assert_allclose(blocks(made.transform(others)), define(x, y, u), rtol=1e-7, atol=1e-7)
    assert len(estimator.features(p)) == got.shape[1]


def test_scaler(spark):
    both_ways(spark, E.Scaler(), lambda x, y, u: (u - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1))


def test_centroids(spark):
    def define(x, y, u):
        a, b = x[y == 0].mean(0), x[y == 1].mean(0)
        w, z = b - a, u - (a + b) / 2
        size, axis, square = np.linalg.norm(w) + 1e-10, z @ w / (np.linalg.norm(w) + 1e-10), (z * z).sum(1)
        off = np.sqrt(np.maximum(square - axis**2, 0))
        return np.stack([np.linalg.norm(u - a, axis=1) - np.linalg.norm(u - b, axis=1), u @ w, u @ w / ((np.linalg.norm(u, axis=1) + 1e-10) * size), axis, off, axis / (np.sqrt(square) + 1e-10), axis / (off / np.sqrt(u.shape[1] - 1) + 1e-10)], 1)

    both_ways(spark, E.Centroids(), define)


def evidence(x, y, u, bins=4, alpha=5.0):
    out = np.empty_like(u)
    for j in range(x.shape[1]):
        positive = x[x[:, j] > 0, j]
        edges = np.unique(np.quantile(positive, np.linspace(0, 1, bins + 1)[1:-1]))
        place = lambda v: np.where(v == 0, 0, 1 + np.searchsorted(edges, v, side="right"))
        ids, width = place(x[:, j]), len(edges) + 2
        c = [np.bincount(ids[y == k], minlength=width) for k in (0, 1)]
        score = np.log((c[1] + alpha) / (c[1].sum() + alpha * width)) - np.log((c[0] + alpha) / (c[0].sum() + alpha * width))
        out[:, j] = score[place(u[:, j])]
    return out


def test_evidence(spark):
    both_ways(spark, E.Evidence(4, keep=True), evidence)

    def sums(x, y, u):
        e = evidence(x, y, u)
        auc = [np.mean([(a > b) + (a == b) / 2 for a in x[y == 1, j] for b in x[y == 0, j]]) for j in range(x.shape[1])]
        order = sorted(range(x.shape[1]), key=lambda j: (-round(abs(auc[j] - 0.5), 9), -j))
        return np.stack([e.sum(1), e[:, order[:3]].sum(1), e[:, order[3:]].sum(1)], 1)

    both_ways(spark, E.Evidence(4, cuts=(0.5, 1.0)), sums)


def test_quantiles(spark):
    def define(x, y, u):
        q = np.quantile(x, np.linspace(0, 1, 11), axis=0)
        out = np.empty_like(u)
        for j in range(u.shape[1]):
            for i, v in enumerate(u[:, j]):
                low, upto = (q[:, j] < v).sum(), (q[:, j] <= v).sum()
                out[i, j] = (low + upto - 1) / 20 if upto > low else 0 if not upto else 1 if low > 10 else (low - 1 + (v - q[low - 1, j]) / (q[low, j] - q[low - 1, j])) / 10
        return out

    both_ways(spark, E.Quantiles(10), define)


def test_projections(spark):
    def axes(x, k, white):
        value, vector = np.linalg.eigh(np.cov(x.T, ddof=0))
        vector = vector[:, ::-1][:, :k]
        vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(k)])
        return vector / np.sqrt(value[::-1][:k]) if white else vector

    both_ways(spark, E.Projection(3), lambda x, y, u: (u - x.mean(0)) @ axes(x, 3, False))
    both_ways(spark, E.Projection(2, white=True), lambda x, y, u: (u - x.mean(0)) @ axes(x, 2, True))
    families = (((0, 2), None), ((1, 3, 4, 5), 2))
    both_ways(spark, E.Projection(families=families), lambda x, y, u: np.concatenate([(u - x.mean(0))[:, [0, 2]] / 2**0.5, (u - x.mean(0))[:, [1, 3, 4, 5]] @ axes(x[:, [1, 3, 4, 5]], 2, True) / 2**0.5], 1))


def test_gaussians(spark):
    def ledoit_wolf(x):
        z, n, p = x - x.mean(0), *x.shape
        s = z.T @ z / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / (p * n * n), delta)
        return G.shrunk(s, beta / delta), s, beta / delta

    def define(x, y, u):
        parts = [ledoit_wolf(x[y == c]) for c in (0, 1)]
        state = G.class_state([int((y == c).sum()) for c in (0, 1)], [x[y == c].mean(0) for c in (0, 1)], [p[1] for p in parts], [p[2] for p in parts], ledoit_wolf(x)[0])
        return np.stack(list(G.scores(u, state).values()), 1)

    both_ways(spark, E.Gaussians(), define)


def test_discriminants(spark):
    def ledoit_wolf(z):
        z, n, p = z - z.mean(0), *z.shape
        c = z.T @ z / n
        mu = np.trace(c) / p
        delta = ((c - mu * np.eye(p)) ** 2).sum() / p
        beta = min(sum(((np.outer(r, r) - c) ** 2).sum() for r in z) / (p * n * n), delta)
        return G.shrunk(c, beta / delta)

    def define(x, y, u):
        share = [np.mean(y == c) for c in (0, 1)]
        parts = [x[y == c] for c in (0, 1)]
        within = sum(s * ledoit_wolf((p - p.mean(0)) / p.std(0)) * np.outer(p.std(0), p.std(0)) for s, p in zip(share, parts))
        linear = [u @ np.linalg.solve(within, p.mean(0)) - 0.5 * p.mean(0) @ np.linalg.solve(within, p.mean(0)) + np.log(s) for s, p in zip(share, parts)]
        quadratic = []
        for s, p in zip(share, parts):
            _, size, axes = np.linalg.svd(p - p.mean(0), full_matrices=False)
            var = 0.95 * size**2 / (len(p) - 1) + 0.05
            quadratic.append(-0.5 * ((((u - p.mean(0)) @ axes.T) ** 2 / var).sum(1) + np.log(var).sum()) + np.log(s))
        return np.stack([linear[1] - linear[0], quadratic[1] - quadratic[0]], 1)

    both_ways(spark, E.Discriminants(), define)


def test_spectrum_ranks():
    found = G.spectrum_ranks(np.diag([4.0, 4.0, 0.0]))
    assert found == pytest.approx({"total": 8, "participation": 2, "entropy": 2, "top1": 0.5, "top3": 1, "top5": 1})


def test_factor_models(spark):
    def log_density(x, u):
        cov = np.cov(x.T, ddof=0)
        w, psi, history = E.factors(cov, 2)
        assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))  # the likelihood never falls
        whole = w @ w.T + np.diag(psi)
        z = u - x.mean(0)
        return -0.5 * (len(cov) * np.log(2 * np.pi) + np.linalg.slogdet(whole)[1] + (z @ np.linalg.inv(whole) * z).sum(1))

    def define(x, y, u):
        a, b = log_density(x[y == 0], u), log_density(x[y == 1], u)
        return np.stack([a, b, b - a], 1)

    both_ways(spark, E.Factors(2), define)
    rng = np.random.default_rng(4)
    w, psi = rng.standard_normal((8, 2)), rng.uniform(0.2, 1, 8)
    found = E.factors(w @ w.T + np.diag(psi), 2, rounds=5000, tolerance=1e-12)
    np.testing.assert_allclose(found[0] @ found[0].T + np.diag(found[1]), w @ w.T + np.diag(psi), atol=1e-3)  # a true model is found again


def test_builders_chain_their_steps(spark):
    x, y, fold, rows = labelled(spark, 120, 6)
    made = E.config("blocks", 3, 4).fit(rows)
    inside, (u, others) = made.out_of_fold(rows), other_rows(spark)
    assert E.coverage(inside, rows).collect() == [(1, 120)]
    geometry = blocks(inside, "centroids")
    scaled = blocks(made.transform(others), "centroids_scaled")
    raw = blocks(made.transform(others), "centroids")
    np.testing.assert_allclose(scaled, (raw - geometry.mean(0)) / geometry.std(0), rtol=1e-7, atol=1e-8)  # the scaler saw the training rows' out-of-fold features
    last = made.transform(others).orderBy("id").collect()
    weights = made.states["decision"].where("model = -1").first()
    joined = np.array([np.concatenate([r[c] for c in made.steps[-1].source]) for r in last])
    np.testing.assert_allclose([r.decision[0] for r in last], joined @ np.array(weights.weights) + weights.intercept, rtol=1e-9)
    np.testing.assert_allclose([r.decision[1] for r in last], 1 / (1 + np.exp(-np.array([r.decision[0] for r in last]))), rtol=1e-9)
    right = (blocks(inside, "decision")[:, 0] > 0) == (y == 1)
    assert right.mean() > 0.6
    with pytest.raises(ValueError):
        E.config("nothing")
    with pytest.raises(ValueError):
        E.Builder([E.Step("a", E.Scaler(), ("b",))]).fit(rows)


def test_model_store(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}/models")
    state = spark.createDataFrame([(-1, [1.0])], "model int, mean array<double>")
    with pytest.raises(LookupError):
        store.load("m")
    first = store.save("m", {"scaler": state}, {"k": 3}, {"scaler": ["z_0"]})
    assert store.load("m")["scaler"].collect() == state.collect() and store.features("m", first) == {"scaler": ["z_0"]}
    second = store.save("m", {"scaler": state.withColumn("model", F.lit(7))})
    with pytest.raises(LookupError):
        store.load("m")  # two versions
    assert store.load("m", second)["scaler"].first().model == 7 and store.load("m", first)["scaler"].first().model == -1
    assert store.versions().count() == 2 and all(r.at > "2000" for r in store.versions().collect())


# --- kernels


def test_kernel_expressions(spark):
    a, b, c = (kernels.Rbf(kernels.Leaf(k, k + 2), 0.5) for k in (0, 2, 4))
    x, _, _, rows = labelled(spark, 40, 6)
    d = lambda k: ((x[:, None, k : k + 2] - x[None, :, k : k + 2]) ** 2).sum(2)
    ka, kb, kc = (np.exp(-0.5 * d(k)) for k in (0, 2, 4))
    e = np.exp([0, 1.0, -1.0]) / np.exp([0, 1.0, -1.0]).sum()
    named = {"soft": kernels.softmax_sum([a, b, c], [1.0, -1.0]), "two": kernels.beta_sum(a, kernels.Product((b, c)), 0.3), "all": kernels.Sum((kernels.Name("soft"), kernels.Name("two"), a), (1.0, 3.0, 0.0))}
    soft, two = e[0] * ka + e[1] * kb + e[2] * kc, 0.3 * ka + 0.7 * kb * kc
    want = {"soft": soft, "two": two, "all": (soft + 3 * two) / 4}
    for size in (7, 1000):
        found = kernels.report(rows, rows, named, size)
        for name, k in want.items():
            np.testing.assert_allclose([r.total for r in found.rows.where(F.col("kernel") == name).orderBy("id").collect()], k.sum(1), rtol=1e-9)
        assert all((r.pairs, r.finite, r.symmetric, r.positive, r.unit) == (1600, True, True, True, True) for r in found.checks.collect())
    with pytest.raises(ValueError):
        kernels.Name("x").named({"x": kernels.Product((kernels.Name("x"), a))})
    with pytest.raises(KeyError):
        kernels.Name("y").named({})
    with pytest.raises(ValueError):
        kernels.Sum((a, b), (1.0, -1.0))


def test_kernel_checks_see_what_is_wrong(spark):
    class Lopsided(kernels.Rbf):
        """Not a kernel: it looks at the order of the two rows, and is not finite at its largest value."""

        def values(self, distance):
            k = np.exp(-self.gamma * distance[self.distance]) * np.linspace(1, 2, distance[self.distance].shape[1])
            return np.where(k == k.max(), np.nan, k)

    rows = labelled(spark, 30, 6)[3]
    r = kernels.report(rows, rows, {"bad": Lopsided(kernels.Leaf(0, 6), 0.5)}).checks.first()
    assert (r.finite, r.symmetric, r.unit) == (False, False, False)
    apart = kernels.report(rows.where("id < 10"), rows.where("id >= 10"), {"k": kernels.Rbf(kernels.Leaf(0, 6), 0.5)}).checks.first()
    assert apart.pairs == 200 and apart.finite


# --- folds of groups


@pytest.mark.parametrize("exact", [64, 4])
def test_group_folds_are_whole_and_even(spark, exact):
    rng = random.Random(3)
    groups = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 7, 20, 40])) for i in range(300)] + [("hot", 500)]
    rows = [(g, rng.random() < 0.2) for g, n in groups for _ in range(n)]
    vec = spark.createDataFrame([(i, g, int(y), "x") for i, (g, y) in enumerate(rows)], "id long, g string, y int, fold2 string")
    got = folds.grouped(vec, 5, "g", exact=exact).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        assert of.setdefault(r.g, r.fold) == r.fold
    largest = 500
    for c in (0, 1):
        each = Counter(r.fold for r in got if r.y == c)
        assert all(abs(each[f] - sum(each.values()) / 5) <= largest for f in range(5))
    rest = Counter(r.fold for r in got if r.g != "hot")
    spare = [f for f in range(5) if f != of["hot"]]
    assert max(rest[f] for f in spare) - min(rest[f] for f in spare) <= 40 and rest[of["hot"]] <= min(rest[f] for f in spare)
    ones = Counter(r.fold for r in got if r.g != "hot" and r.y == 1)
    assert max(ones[f] for f in spare) - min(ones[f] for f in spare) <= 40
    assert folds.grouped(vec.where("false"), 5, "g").count() == 0
    odd = folds.grouped(spark.createDataFrame([(i, None, None) for i in range(50)], "id long, g string, y int"), 5, "g")
    assert odd.count() == 50 and odd.select("fold").distinct().count() == 5


# --- isotonic fits


def pool(n, pos):
    """Pool adjacent violators, the plain way: the share at each value."""
    stack = []
    for a, b in zip(n, pos):
        stack.append([a, b, 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            a2, b2, k = stack.pop()
            stack[-1] = [stack[-1][0] + a2, stack[-1][1] + b2, stack[-1][2] + k]
    return [b / a for a, b, k in stack for _ in range(k)]


@pytest.mark.parametrize("steps", [2, 7, 500])
def test_isotonic_blocks_equal_brute_force(spark, steps):
    rng = random.Random(steps)
    rows, want = [], {}
    for g in range(4):
        values = sorted({round(rng.random() ** (g + 1), 3) for _ in range(300)})
        n = [rng.randrange(1, 5) for _ in values]
        pos = [sum(rng.random() < v for _ in range(k)) for v, k in zip(values, n)]
        rows += [(g, v, k, p) for v, k, p in zip(values, n, pos)]
        want |= {(g, v): p for v, p in zip(values, pool(n, pos))}
    found = isotonic.blocks(spark.createDataFrame(rows, "g int, v double, n long, pos long"), "g", steps=steps).collect()
    for (g, v), p in want.items():
        inside = [r for r in found if r.g == g and r.lo <= v <= r.hi]
        assert len(inside) == 1 and inside[0].pos / inside[0].n == pytest.approx(p)


def test_isotonic_evidence(spark):
    def define(x, y, u):
        out = np.empty_like(u)
        for j in range(x.shape[1]):
            auc = np.mean([(a > b) + (a == b) / 2 for a in x[y == 1, j] for b in x[y == 0, j]])
            sign = 1 if auc >= 0.5 else -1
            values = np.unique(sign * x[:, j])
            n = [int((sign * x[:, j] == v).sum()) for v in values]
            pos = [int(y[sign * x[:, j] == v].sum()) for v in values]
            p = np.clip(np.interp(sign * u[:, j], values, pool(n, pos)), 1e-4, 1 - 1e-4)
            out[:, j] = np.log(p / (1 - p))
        return out

    both_ways(spark, isotonic.Isotonic(), define)
    both_ways(spark, isotonic.Isotonic(), define, p=1)


# --- stages of boosting


def test_the_last_stage_is_the_models_own_score(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    from quillstone.operators.learners import prepared

    rows = labelled(spark, 200, 6)[3]
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(prepared(rows))
    own = model.transform(prepared(rows)).select("id", "x", vector_to_array("rawPrediction")[1].alias("raw"))
    for r in own.withColumn("m", staged.stage_margins(model, F.col("x"))).collect():
        assert len(r.m) == 5 and r.m[-1] * 2 == pytest.approx(2 * r.raw, abs=1e-9) or r.m[-1] == pytest.approx(r.raw / 2, abs=1e-9)
    found = staged.history(model, rows, rows.where("id < 40")).orderBy("stage").collect()
    assert [r.stage for r in found] == [1, 2, 3, 4, 5] and found[-1].train_auc >= found[0].train_auc and all(r.gap == pytest.approx(r.train_auc - r.valid_auc) for r in found)


# --- hierarchies


@pytest.mark.parametrize("method", ["ward", "average"])
def test_merges_equal_brute_force(method):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((14, 3))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    got = hierarchy.merges(d, method)
    clusters = {i: [i] for i in range(14)}
    for k, (a, b, height, size) in enumerate(got):
        def cost(u, v):
            p, q = clusters[u], clusters[v]
            if method == "average":
                return d[np.ix_(p, q)].mean()
            gap = points[p].mean(0) - points[q].mean(0)
            return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * (gap @ gap))

        names = sorted(clusters)
        best = min((cost(u, v), u, v) for i, u in enumerate(names) for v in names[i + 1 :])
        assert (a, b) == best[1:] and height == pytest.approx(best[0]) and size == len(clusters[a]) + len(clusters[b])
        clusters[14 + k] = clusters.pop(a) + clusters.pop(b)
    assert sorted(hierarchy.order(got, 14)) == list(range(14))
    four = hierarchy.groups(got, 14, 4)
    assert len(four) == 4 and sorted(j for c in four for j in c) == list(range(14))
    assert hierarchy.merges(np.zeros((3, 3)))[0][:2] == (0, 1)  # ties go to the smaller numbers


def test_column_distances_and_groups_over_rows(spark):
    x, _, _, rows = labelled(spark, 50, 6)
    d = hierarchy.column_distances(rows, 6)
    np.testing.assert_allclose(d, ((x.T[:, None] - x.T[None]) ** 2).sum(2), atol=1e-8)
    clusters = [[0, 3], [1, 2, 5], [4]]
    got = blocks(rows.withColumn("out", hierarchy.agglomerated(F.col("x"), clusters)))
    np.testing.assert_allclose(got, np.stack([x[:, c].mean(1) for c in clusters], 1))
    signs = hierarchy.signs(6, 200, sparsity=3)
    z = blocks(rows.withColumn("out", hierarchy.projected(F.col("x"), signs, 3)))
    np.testing.assert_allclose(z, x @ np.array(signs, float).T * np.sqrt(3 / 200))
    share = np.mean(np.array(signs) != 0)
    assert 0.25 < share < 0.42  # one in three


# --- trials


def fake(calls):
    """An evaluation that knows its results: by settings, repeat and fold."""

    def evaluate(spark, settings, repeats):
        calls.append(settings["a"])
        return spark.createDataFrame([(r, f, 0.5 + settings["a"] / 10 - 0.01 * r + 0.001 * f) for r in repeats for f in range(2)], "repeat int, fold int, auc double")

    return evaluate


def test_trials_resume_and_select(spark, tmp_path):
    import duckdb

    from quillstone.operators import search

    calls, root = [], f"{tmp_path}/trials"
    evaluate = lambda s, repeats: fake(calls)(spark, s, repeats)
    settings, trials = search.grid({"a": [1, 2, 3]}), search.Trials(spark, f"file://{root}")
    assert trials.table().count() == 0
    trials.run("one", settings[:1], lambda s: evaluate(s, [0]))
    found = search.two_stages(trials, settings, evaluate, repeats=3, keep=2, within=0.02).collect()
    assert sorted(calls) == [1, 2, 2, 3, 3]  # the first trial was there; two were confirmed
    assert {r.settings: (r.passes, r.best) for r in found} == {'{"a": 3}': (True, True), '{"a": 2}': (True, False)}
    search.two_stages(search.Trials(spark, f"file://{root}"), settings, evaluate, repeats=3, keep=2)
    assert len(calls) == 5  # a later run computes nothing again
    assert not any(r.passes for r in search.two_stages(trials, settings, evaluate, repeats=3, keep=2, within=0.001).collect())
    said = duckdb.sql(f"SELECT settings FROM (SELECT settings, round(avg(auc), 9) AS m, round(stddev_pop(auc), 9) AS s FROM read_parquet('{root}/stage=one/*/*.parquet') GROUP BY settings ORDER BY m DESC, s, settings LIMIT 2)").fetchall()
    assert [r[0] for r in said] == [search.key_of(s) for s in search.best(trials.table(), "one", 2)]
    assert trials.table().count() == 3 * 2 + 2 * 6


def test_drawn_settings_repeat():
    from quillstone.operators import search

    space = {"a": list(range(10)), "b": list(range(10))}
    one = search.drawn(space, 7, 3)
    assert one == search.drawn(space, 7, 3) != search.drawn(space, 7, 4) and len({search.key_of(s) for s in one}) == 7


def test_refit_leaves_out_doubted_labels(spark):
    from pyspark.ml.classification import LogisticRegression

    from quillstone.operators import learners

    rng = np.random.default_rng(3)
    y = np.arange(300) % 2
    x = rng.standard_normal((300, 3)) + 3 * y[:, None]
    wrong = set(range(0, 300, 15))
    rows = spark.createDataFrame([(i, int(y[i]) if i not in wrong else 1 - int(y[i]), x[i].tolist()) for i in range(300)], "id long, y int, x array<double>")
    got = learners.refitted(LogisticRegression(maxIter=20), True, rows, rows).collect()
    assert 12 <= got[0].left_out <= 30 and len(got) == 300
    assert np.mean([(r.score > 0.5) == (y[r.id] == 1) for r in got]) > 0.95
    assert learners.refitted(LogisticRegression(maxIter=5), False, rows, rows).first().left_out == 0


# --- extremely randomised trees


def test_extra_trees(spark):
    from quillstone.operators import extra_trees

    x, y, _, rows = labelled(spark, 300, 6)
    parted = rows.withColumn("y", (F.col("x")[5] > 0.7).cast("int"))
    forest = extra_trees.fit(parted, 6, trees=8, depth=5, least=3, most=3, seed=2)
    got = parted.withColumn("s", extra_trees.score(forest, F.col("x"))).collect()
    assert np.mean([(r.s > 0.5) == (r.y == 1) for r in got]) > 0.95
    again = extra_trees.fit(parted.repartition(7), 6, trees=8, depth=5, least=3, most=3, seed=2)
    assert again == forest != extra_trees.fit(parted, 6, trees=8, depth=5, least=3, most=3, seed=3)
    # Every node's share and split by the rows that reach it.
    target = np.array([r.y for r in parted.orderBy("id").collect()])
    for t, tree in enumerate(forest):
        def check(i, at, tree=tree, t=t):
            n = tree[i]
            assert n.share == pytest.approx(target[at].mean())
            if n.column is not None:
                assert n.column in extra_trees.looked_at(2, t, i, 6, 3)
                v = x[at, n.column]
                assert n.threshold == pytest.approx(v.min() + (v.max() - v.min()) * extra_trees._unit(2, "cut", t, i, n.column))
                low = at[v <= n.threshold]
                high = at[v > n.threshold]
                assert len(low) >= 3 and len(high) >= 3
                check(2 * i + 1, low)
                check(2 * i + 2, high)

        check(0, np.arange(300))
    one = extra_trees.fit(rows.withColumn("y", F.lit(1)), 6, trees=2)
    assert [t[0].share for t in one] == [1, 1] and extra_trees.fit(rows.where("false"), 6, trees=1)[0][0].share == 0.5


# --- learned metric


def test_metric_gradient_and_descent(spark):
    from quillstone.operators import metric

    rng = np.random.default_rng(6)
    delta, same, theta = rng.standard_normal((30, 4)), rng.random(30) < 0.5, rng.standard_normal(4 + 2 * 4 + 1) * 0.5
    _, gradient = metric.loss_and_gradient(theta, delta, same, 0.01)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = (metric.loss_and_gradient(theta + s * step, delta, same, 0.01)[0] for s in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)
    x, y, fold, rows = labelled(spark, 120, 6)
    learner = metric.Metric(rank=2, rounds=12)
    pairs = learner.pairs(rows, "x").cache()
    assert pairs.count() == 480
    whole = learner.sums(pairs, np.tile(learner.start(6), (4, 1)), 3)
    for m in range(4):  # model m - 1 sees no pair with a row of its fold
        at = [r for r in pairs.collect() if m - 1 not in (r.f1, r.f2)]
        loss, g = metric.loss_and_gradient(learner.start(6), np.array([r.delta for r in at]), np.array([r.same for r in at]), learner.ridge)
        np.testing.assert_allclose(whole[m], [len(at), loss, *g], rtol=1e-9)
    _, losses = learner.descend(pairs, 6, 3)
    assert (losses[-1] < losses[0]).all()
    made = E.Builder([E.Step("out", learner)], 3).fit(rows)
    state = {r.model: r for r in made.states["out"].collect()}
    z = blocks(made.out_of_fold(rows))
    for i in (0, 7, 50):
        s = state[int(fold[i])]
        np.testing.assert_allclose(z[i], np.concatenate([x[i] * np.array(s.weights), np.array(s.turn) @ x[i]]), rtol=1e-9)


# --- small helpers


def test_signed_rank_p_equals_enumeration():
    import itertools

    from quillstone.operators.comparison import signed_rank_p, wilcoxon_p

    for d in ([0.1, -0.2, 0.3, 0.4], [0.1, 0.1, -0.1, 0.2, 0.0, 0.2], [0, 0], [-1, -1, -1, -1, -1]):
        used = [x for x in d if x]
        size = sorted(map(abs, used))
        rank = {a: sum(i + 1 for i, b in enumerate(size) if b == a) / size.count(a) for a in size}
        total = [sum(rank[abs(x)] for x, s in zip(used, signs) if s) for signs in itertools.product([0, 1], repeat=len(used))]
        plus = sum(rank[abs(x)] for x in used if x > 0)
        low = min(plus, sum(rank[abs(x)] for x in used) - plus)
        want = min(1.0, 2 * sum(t <= low for t in total) / len(total)) if used else 1.0
        assert signed_rank_p(d) == pytest.approx(want)
    assert signed_rank_p([1, 2, 3, -4, 5]) == wilcoxon_p(11, 5)


def test_strict_weights_and_located_tables(spark, tmp_path):
    from quillstone.operators.comparison import sums_to_one
    from quillstone.sources.files import locate

    good = spark.createDataFrame([("a", "m", 0.25), ("a", "n", 0.75)], "name string, model string, weight double")
    assert sums_to_one(good).collect() == good.collect()
    for bad in ([("a", "m", 0.5)], [("a", "m", 1.5), ("a", "n", -0.5)]):
        with pytest.raises(Exception, match="sum to one"):
            sums_to_one(spark.createDataFrame(bad, good.schema)).collect()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "orders.parquet").mkdir()
    assert locate(spark, [f"{tmp_path}/none", f"{tmp_path}/x"], ["orders"]) == f"{tmp_path}/x"
    with pytest.raises(FileNotFoundError, match="part"):
        locate(spark, [f"{tmp_path}/x"], ["orders", "part"])


def test_command_line(spark, tmp_path, capsys):
    from quillstone.__main__ import main

    assert main([]) == 0 and "feature_auc" in capsys.readouterr().out
    assert main(["--tables", "/root/testdata/sf0.001", "--out", str(tmp_path), "column_range"]) == 0
    name, n, _ = capsys.readouterr().out.strip().split("\t")
    assert name == "column_range" and int(n) > 0 and len(list(tmp_path.glob("*/column_range/*.parquet"))) > 0
    with pytest.raises(SystemExit):
        main(["no_such_query"])
