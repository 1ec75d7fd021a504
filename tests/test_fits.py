"""Fits over many rows: nothing is joined or moved for each of them, and scores are those of the plainer way."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quillstone.operators import folds
from quillstone.operators import learners as L
from quillstone.plans import models, registry
from quillstone.sources.fixtures import order_vec

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bagged_scores_rows_in_place(spark):
    got = registry.QUERIES["bagged"](spark, DIR)
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    rows = models._folded(order_vec(spark, DIR)).cache()
    drawn = folds.bootstrap(rows, 5, 3)
    train, held = rows.where("fold <> 1"), L.prepared(rows.where("fold = 1"))
    parts = []
    for m in range(5):
        own = L.prepared(train.join(drawn.where(F.col("member") == m).select("id", F.col("weight").cast("double").alias("w")), "id"))
        parts += L.positive(LogisticRegression(maxIter=15, regParam=0.01, weightCol="w").fit(own).transform(held)).collect()
    want: dict = {}
    for r in parts:
        want.setdefault(r.id, []).append(r.score)
    assert {r.id: r.score for r in got.where("fold = 1").collect()} == pytest.approx({i: sum(v) / 5 for i, v in want.items()}, abs=2e-6)
    rows.unpersist()


def test_mixtures_score_all_folds_in_one_pass(spark):
    got = registry.QUERIES["mixture_components"](spark, DIR)
    assert "Union" not in plan(got) and plan(got).count("Arrow") == 1


def test_densities_by_fold(spark):
    rng = np.random.default_rng(1)
    x, fold = rng.standard_normal((50, 3)), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(i, int(f), v.tolist()) for i, (f, v) in enumerate(zip(fold, x, strict=True))], "id long, fold int, x array<double>")
    component = lambda w, m, s: (np.log(w) - 1.5 * np.log(2 * np.pi) - 3 * np.log(s), np.full(3, m), np.eye(3) / s)
    states = [[[component(0.3, 0.0, 1.0), component(0.7, 1.0, 2.0)], [component(1.0, f, 1.0)]] for f in (0.0, 0.5)]
    normal = lambda v, m, s: np.exp(-0.5 * (((v - m) / s) ** 2).sum()) / (2 * np.pi) ** 1.5 / s**3
    for r in L.fold_densities(df, states, ["a", "b"]).collect():
        v = x[r.id]
        assert r.fold == fold[r.id] and r.a == pytest.approx(np.log(0.3 * normal(v, 0, 1) + 0.7 * normal(v, 1, 2))) and r.b == pytest.approx(np.log(normal(v, 0.5 * r.fold, 1)))


def test_builders_leave_no_rows_behind(spark):
    from pathlib import Path

    from quillstone.operators import estimators as E
    from quillstone.operators.graph import scratch_root
    from quillstone.plans.external import training_rows

    root = Path(scratch_root(spark).removeprefix("file:"))
    there = lambda: {p.name for kind in ("builder-rows", "linear-rows") for p in root.glob(f"{kind}-*")}
    rows, before = training_rows(spark, DIR), there()
    made = E.config("blocks").fit(rows, outward=True)
    assert there() == before
    assert [r.model for r in made.states["decision"].collect()] == [-1]  # no step reads it
    assert {r.model for r in made.states["gaussians"].collect()} == set(range(-1, 5))
    with pytest.raises(ValueError, match="other tables only"):
        made.out_of_fold(rows)
    whole = E.config("blocks").fit(rows)
    assert there() == before and whole.out_of_fold(rows).count() == rows.count()
    one, other = ({r.id: r.decision[0] for r in b.transform(rows.select("id", "x")).select("id", "decision").collect()} for b in (made, whole))
    assert one == pytest.approx(other)
