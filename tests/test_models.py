"""Model operators: property tests (bounds, better than a constant,
deterministic for a fixed seed) and the grid/refit recipe."""
import math
import random

import pytest
from pyspark.sql import functions as F

from leverkit.operators import models
from leverkit.operators.verbs import param_grid, stratified_split


@pytest.fixture(scope="module")
def toy(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rnd.random(), rnd.random()
        y = 1 if a + 0.3 * rnd.random() > 0.6 else 0
        rows.append((i, a, b, y, 3 * a + b + 0.1 * rnd.random()))
    return spark.createDataFrame(rows, "k long, a double, b double, y int, z double")


def test_classifier_probabilities_and_loss(spark, toy):
    fit = models.fit_gbt(toy, ["a", "b"], "y", kind="classifier",
                         grid={"max_depth": [2, 3]}, max_rounds=8, key=["k"])
    assert len(fit.grid) == 2 and 1 <= fit.rounds <= 8
    p = models.score(fit.model, toy, "p", kind="classifier")
    stats = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi"),
                  F.avg(-(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p"))))
                  .alias("ll"), F.avg("y").alias("m")).first()
    assert 0 <= stats.lo and stats.hi <= 1
    base = -(stats.m * math.log(stats.m) + (1 - stats.m) * math.log(1 - stats.m))
    assert stats.ll < base


def test_top_grid_and_model_round_trip(spark, toy):
    import tempfile
    from leverkit.sources import io
    fit = models.fit_gbt(toy, ["a", "b"], "z", grid={"max_depth": [2, 3], "subsample": [1.0]},
                         max_rounds=4, key=["k"])
    best = models.top_grid(fit, 5)
    assert len(best) == 2 and best[0]["metric"] <= best[1]["metric"]
    assert fit.metric < fit.constant
    kept = tempfile.mkdtemp(prefix="lk-model-") + "/fit"
    fit.context["drop_level"] = "___"
    models.save_fit(fit, kept)
    assert models.load_fit(kept)[1] == {"drop_level": "___"}
    path = tempfile.mkdtemp(prefix="lk-model-") + "/m"
    io.save_model(fit.model, path)
    back = io.load_model(path)
    a = models.score(fit.model, toy, "zh").orderBy("k").select("zh").collect()
    b = models.score(back, toy, "zh").orderBy("k").select("zh").collect()
    assert a == b


def test_regressor_beats_mean_and_is_deterministic(spark, toy):
    kw = dict(grid={"max_depth": [2]}, fixed={"eta": 0.3, "weight": 2}, max_rounds=6, key=["k"])
    f1 = models.fit_gbt(toy, ["a", "b"], "z", **kw)
    f2 = models.fit_gbt(toy, ["a", "b"], "z", **kw)
    s1 = models.score(f1.model, toy, "zh").orderBy("k").select("zh").collect()
    s2 = models.score(f2.model, toy, "zh").orderBy("k").select("zh").collect()
    assert s1 == s2
    out = models.score(f1.model, toy, "zh")
    mse = out.agg(F.avg((F.col("zh") - F.col("z")) ** 2)).first()[0]
    var = toy.agg(F.var_pop("z")).first()[0]
    assert mse < var


def test_negative_predictions_floored(spark, toy):
    fit = models.fit_gbt(toy.withColumn("z", F.col("z") - 3), ["a", "b"], "z",
                         fixed={"max_depth": 2, "rounds": 3}, max_rounds=3, key=["k"])
    out = models.score(fit.model, toy, "zh", floor=0.001)
    assert out.agg(F.min("zh")).first()[0] >= 0.001 - 1e-12


def test_param_grid_and_split(spark, toy):
    g = param_grid(spark, max_depth=[3, 4, 6, 8], weight=[1, 4, 8, 12, 16],
                   subsample=[0.5, 0.75, 1.0])
    assert g.count() == 60 and g.agg(F.max("row_num")).first()[0] == 60
    s = stratified_split(toy, ["k"], "y", 0.75)
    per = {r.y: (r.n, r.t) for r in s.groupBy("y").agg(F.count("*").alias("n"),
                                                     F.sum("is_train").alias("t")).collect()}
    for n, t in per.values():
        assert t == math.floor(n * 0.75)
    s2 = stratified_split(toy, ["k"], "z", 0.75, numeric_bins=4)
    assert s2.agg(F.sum("is_train")).first()[0] >= 290


def test_features_fixed_schema(spark):
    df = spark.createDataFrame([("Top", 0.3, 1, 2, 5, 0, "___"), ("Bot", None, 2, 2, 11, 1, "321")],
                               "h string, r double, b int, f int, inn int, o int, s string")
    x, feats = models.win_expectancy_features(df, "h", "r", "b", "f", "inn", "o", "s")
    assert len(feats) == 9 + 7
    row = x.where("h = 'Bot'").first()
    assert row.walkoff_possibility == 1.0 and row.inning_capped == 10.0


def test_cross_fit_scores_every_row_once(spark, toy):
    out = models.cross_fit_score(toy, ["a", "b"], "z", "zh", "k", k=3,
                                 params={"max_depth": 2}, rounds=3)
    assert out.count() == toy.count()
    assert out.select("k").distinct().count() == toy.count()
    assert out.where("zh IS NULL").count() == 0


def test_published_grids_and_patience(spark, toy):
    assert all(math.prod(map(len, t["grid"].values())) == 60 for t in models.TUNING.values())
    fit = models.fit_gbt(toy, ["a", "b"], "z", fixed={"max_depth": 2, "eta": 0.9}, max_rounds=40, patience=2, key=["k"])
    assert fit.rounds < 40 and fit.metric < fit.constant
    set_rounds = models.fit_gbt(toy, ["a", "b"], "z", fixed={"max_depth": 2, "rounds": 3}, key=["k"])
    assert set_rounds.rounds == 3 and set_rounds.metric is None and set_rounds.model.stages[-1].getNumTrees == 3


def test_missing_values_are_told_apart(spark):
    rows = [(i, None if i % 2 else 1.0, 5.0 * (i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, a double, z double")
    fit = models.fit_gbt(df, ["a"], "z", fixed={"max_depth": 1, "rounds": 3, "eta": 1.0}, key=["k"], nullable=["a"])
    got = models.score(fit.model, df, "zh")
    assert got.columns == ["k", "a", "z", "zh"]
    assert got.agg(F.max(F.abs(F.col("zh") - F.col("z")))).first()[0] < 0.1


def test_null_stratum_and_null_groups(spark):
    from leverkit.operators import saved, verbs
    df = spark.createDataFrame([(i, None if i < 20 else "a", float(i)) for i in range(40)], "k long, g string, v double")
    got = stratified_split(df, ["k"], "g", 0.75)
    assert {(r.g, r.is_train): r["count"] for r in got.groupBy("g", "is_train").count().collect()} == {
        (None, 1): 15, (None, 0): 5, ("a", 1): 15, ("a", 0): 5}
    assert saved.trim_open_quantiles(df, ["g"], "v").groupBy("g").count().count() == 2
    assert verbs.having_group_total(df, ["g"], "v", 0).count() == 40


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_boosting_goes_on_as_one_fit(spark, toy, kind):
    """Rounds that go on from the written sums have the losses of one straight
    fit of as many rounds."""
    from pyspark.ml.feature import VectorAssembler
    label = "y" if kind == "classifier" else "z"
    x = toy.withColumn(label, F.col(label).cast("double")).withColumn("is_train", (F.col("k") % 4 > 0).cast("int"))
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x).select(label, "features", "is_train").coalesce(1).checkpoint()
    how = dict(max_depth=2, weight=2, subsample=1.0, eta=0.1)
    straight = models.boosted_losses(x, label, kind, how, 16, 16, 7, first=16)
    on = models.boosted_losses(x, label, kind, how, 16, 16, 7, first=4)
    assert len(on) == len(straight) == 16
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(on, straight))


def test_patience_ends_the_boosting(spark):
    """Noise: nothing gets better, so it ends ``patience`` rounds after its best."""
    from pyspark.ml.feature import VectorAssembler
    r = random.Random(3)
    df = spark.createDataFrame([(r.random(), r.gauss(0, 1), int(i % 3 > 0)) for i in range(300)], "a double, z double, is_train int")
    x = VectorAssembler(inputCols=["a"], outputCol="features").transform(df).select("z", "features", "is_train").coalesce(1).checkpoint()
    got = models.boosted_losses(x, "z", "regressor", dict(max_depth=4, eta=0.5), 200, 6, 1, first=3)
    best = got.index(min(got))
    assert best + 6 < len(got) <= best + 6 + 2 * models.BLOCK


def test_further_rounds_are_of_one_fit(spark, toy, monkeypatch):
    """Rounds beyond the first are not fitted a tree at a time: few fits, each
    several times as long, up to the ceiling."""
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(toy.withColumn("is_train", (F.col("k") % 4 > 0).cast("int")))
    x, asked, plain = x.select("z", "features", "is_train").coalesce(1).checkpoint(), [], models._estimator
    monkeypatch.setattr(models, "_estimator", lambda kind, label, p, rounds, seed: (asked.append(rounds), plain(kind, label, p, rounds, seed))[1])
    got = models.boosted_losses(x, "z", "regressor", dict(max_depth=1, eta=0.01), 12, 12, 1, first=2)
    assert asked == [2, 12] and len(got) == 12
    assert models._until([3, 2, 2, 2, 1], 2) == (4, True) and models._until([3, 2, 1], 2) == (3, False)


def test_published_arguments():
    assert models.published("runs_statline") == {"fixed": models.RUNS_STATLINE_BEST, "max_rounds": 5000}
    search = models.published("swing", tune=True)
    assert search["fixed"] == {"eta": 0.5} and search["max_rounds"] == 500 and math.prod(map(len, search["grid"].values())) == 60
