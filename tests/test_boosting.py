"""Boosting in one job: the trees are MLlib's, in one task or in several."""
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from leverkit.operators import boosting, models


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    data = []
    for i in range(900):
        a, b, c = r.random(), r.gauss(0, 1), float(r.randrange(5))
        y = a * 3 + (b > 0.3) * c + r.gauss(0, 0.4)
        data.append((i, a, b, c, float(r.random() < 0.3), 1.0, y, float(y > 2), int(i % 4 > 0)))
    x = spark.createDataFrame(data, "k long, a double, b double, c double, d double, same double, z double, y double, is_train int")
    return VectorAssembler(inputCols=["a", "b", "c", "d", "same"], outputCol="features").transform(x).checkpoint()


def _mllib(rows, label, kind, p, n):
    train, valid = rows.where("is_train = 1"), rows.where("is_train = 0")
    fit = models._estimator(kind, label, p, n, 101).fit(train)
    return fit, list(fit.evaluateEachIteration(valid) if kind == "classifier" else fit.evaluateEachIteration(valid, "squared"))


@pytest.mark.parametrize("kind,tasks,depth", [("regressor", 1, 4), ("regressor", 3, 3), ("classifier", 1, 3), ("classifier", 4, 5)])
def test_rounds_are_those_of_mllib(spark, rows, kind, tasks, depth):
    """Same held-out loss after each round, same predictions of the model, same importances."""
    label = "y" if kind == "classifier" else "z"
    p = dict(max_depth=depth, weight=3, subsample=1.0, eta=0.1)
    want, losses = _mllib(rows, label, kind, p, 25)
    (got,), cuts = boosting.boost(rows, label, ["features"], [models._job(0, kind, p, 25, 101, patience=50)], tasks)
    assert np.allclose(got["losses"], losses, rtol=1e-9)
    mine = boosting.as_model(spark, models._estimator(kind, label, p, 25, 101), got["trees"], cuts[0])
    assert mine.getNumTrees == 25 and mine.treeWeights == want.treeWeights
    assert np.allclose(mine.featureImportances.toArray(), want.featureImportances.toArray(), rtol=1e-6)
    name = "probability" if kind == "classifier" else "prediction"
    a, b = ([r[0] for r in m.transform(rows).orderBy("k").select(name).collect()] for m in (mine, want))
    assert np.allclose(np.array([list(v) for v in a] if kind == "classifier" else a), np.array([list(v) for v in b] if kind == "classifier" else b))


def test_thresholds_are_those_of_mllib():
    few = boosting.thresholds(np.array([0.0, 1.0, 4.0]), np.array([3.0, 1.0, 2.0]))
    assert few.tolist() == [0.5, 2.5]
    many = boosting.thresholds(np.arange(1000.0), np.ones(1000))
    assert len(many) == 63 and np.abs(np.diff(many) - 1000 / 64).max() <= 1
    # a value with most of the rows does not take the other thresholds with it
    heavy = boosting.thresholds(np.arange(200.0), np.r_[10_000.0, np.ones(199)])
    assert heavy[0] == 0.5 and len(heavy) >= 1
    v, n = boosting._summary(np.random.default_rng(1).random(50_000), np.ones(50_000))
    assert len(v) <= boosting.SUMMARY and n.sum() == 50_000 and n.max() < 2 * 50_000 / boosting.SUMMARY + 2


def test_refit_grows_along_and_samples_are_repeatable(spark, rows):
    """The refit stops with the tuning fit; its trees are those of a fit of its
    own; the rows of a sample are the same each time."""
    p = dict(max_depth=3, weight=3, subsample=0.5, eta=0.4)
    jobs = [models._job(0, "regressor", p, 300, 7, patience=5), models._job(0, "regressor", p, 300, 7, all_rows=True, follows=0)]
    (tuned, whole), _ = boosting.boost(rows, "z", ["features"], jobs, 2)
    best = int(np.argmin(tuned["losses"]))
    assert len(tuned["losses"]) == best + 6 < 300 and best + 6 <= len(whole["trees"]) <= best + 7
    (alone,), _ = boosting.boost(rows, "z", ["features"], [models._job(0, "regressor", p, best + 1, 7, patience=50)], 2)
    assert alone["losses"] == tuned["losses"][:best + 1]
    counts = {t["stats"][0] for t in whole["trees"]}
    assert len(counts) > 1 and all(300 < c < 600 for c in counts)


def test_one_job_for_all_rounds(spark, rows):
    """A round used to be several jobs, so thousands of rounds ran out of time."""
    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        fit = models.fit_gbt(rows.drop("features", "is_train"), ["a", "b", "c"], "z", fixed={"max_depth": 2, "eta": 0.01},
                             max_rounds=300, patience=300, key=["k"])
    finally:
        n = jobs()
        spark.sparkContext.setJobGroup("", "")
    assert fit.grid[0]["tried"] == 300 and n < 100


def test_equal_columns_and_no_split(spark):
    """A feature with one value, or rows too few for a split: trees of one leaf."""
    x = spark.range(30).select(F.lit(2.0).alias("a"), F.col("id").cast("double").alias("z"), F.lit(1).alias("is_train"))
    x = VectorAssembler(inputCols=["a"], outputCol="features").transform(x)
    (got,), cuts = boosting.boost(x, "z", ["features"], [models._job(0, "regressor", {"max_depth": 2}, 2, 1, all_rows=True)], 1)
    model = boosting.as_model(spark, models._estimator("regressor", "z", {"max_depth": 2}, 2, 1), got["trees"], cuts[0])
    assert {r.prediction for r in model.transform(x).collect()} == {14.5}
    with pytest.raises(ValueError):
        boosting.boost(x.where("z < 0"), "z", ["features"], [models._job(0, "regressor", {}, 2, 1, all_rows=True)], 1)


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_scores_are_those_of_mllib(spark, rows, kind, monkeypatch, tmp_path):
    """Scoring tree by tree has MLlib's predictions, of a fitted model and of a loaded one."""
    label = "y" if kind == "classifier" else "z"
    x = rows.drop("features", "is_train")
    fit = models.fit_gbt(x, ["a", "b", "c"], label, kind=kind, fixed={"max_depth": 3, "rounds": 30, "eta": 0.2}, key=["k"], nullable=["b"])
    models.save_fit(fit, str(tmp_path / "fit"))
    want = [r.p for r in models.score(fit.model, x, "p", kind=kind, floor=0.2).orderBy("k").collect()]
    monkeypatch.setattr(models, "MANY_TREES", 5)
    monkeypatch.setattr(type(fit.model.stages[-1]), "transform", None)
    for model in (fit.model, models.load_fit(str(tmp_path / "fit"))[0]):
        out = models.score(model, x, "p", kind=kind, floor=0.2)
        assert out.columns == [*x.columns, "p"]
        assert np.allclose([r.p for r in out.orderBy("k").collect()], want, rtol=1e-9)


def test_a_query_makes_its_rows_once(spark, monkeypatch):
    """The model queries fit and score a written copy of their feature table."""
    from leverkit.plans import model_bindings
    seen = []

    def fit(df, *a, **k):
        seen.append(df)
        raise StopIteration
    monkeypatch.setattr(models, "fit_gbt", fit)
    with pytest.raises(StopIteration):
        model_bindings.q_gbt_regress(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and not any(w in plan for w in ("Exchange", "Join", "Window", "Aggregate", "FileScan"))
