"""Expectation models: gradient-boosted trees with a held-out grid search.

The fitting follows one recipe for all five models: a deterministic
stratified split, a parameter grid fitted on the training part, the
validation loss read for every boosting round, the best (parameters, round)
kept, and a refit on all rows with those settings.  Scoring is
``PipelineModel.transform`` on the same feature function, so imputation
means are fitted once and reused; the one-hot level that is left out is found
once (``modal_state``), kept in ``FitResult.context`` and saved with the model.
The trees are grown in one distributed job for all rounds (``boosting``), a few
grid points at a time.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import state as st
from ..functions.nulls import flag
from ..functions.zones import ZONES
from ..session import materialize, shared_dir
from . import boosting
from .verbs import one_hot, stratified_split

# --- fixed values: the published tuning grids (60 points each), learning
# rates while tuning, round ceilings, patience, and the best settings
_WEIGHTS, _SUBSAMPLES = [1, 4, 8, 12, 16], [0.5, 0.75, 1.0]
WIN_GRID = dict(max_depth=[3, 4, 6, 8], weight=_WEIGHTS, subsample=_SUBSAMPLES)
RUN_EXP_GRID = dict(max_depth=[3, 4, 6, 8], weight=_WEIGHTS, subsample=_SUBSAMPLES)
SWING_GRID = dict(max_depth=[3, 4, 6, 8], weight=_WEIGHTS, subsample=_SUBSAMPLES)
RUNS_STATLINE_GRID = dict(max_depth=[3, 4, 6, 8], weight=_WEIGHTS, subsample=_SUBSAMPLES)
RUNS_STATE_GRID = dict(max_depth=[2, 3, 4, 6, 8], weight=[12, 16, 20, 24], subsample=_SUBSAMPLES)
TUNING = {
    "win": dict(grid=WIN_GRID, fixed=dict(eta=0.3), max_rounds=1000),
    "run_exp": dict(grid=RUN_EXP_GRID, fixed=dict(eta=0.3), max_rounds=1000),
    "runs_state": dict(grid=RUNS_STATE_GRID, fixed=dict(eta=0.05), max_rounds=1000),
    "runs_statline": dict(grid=RUNS_STATLINE_GRID, fixed=dict(eta=0.05), max_rounds=5000),
    "swing": dict(grid=SWING_GRID, fixed=dict(eta=0.5), max_rounds=500),
}
PATIENCE = 50
#: rounds between two checkpoints of a fit
BLOCK = 10
#: how many times the rounds of a fit that was too short the next one has
GROWTH = 4
#: rows a task of a fit has at least: a round is several jobs, which on a small
#: table take longer the more tasks they have
ROWS_A_TASK = 20_000
#: trees from which a model is scored tree by tree over many rows at a time
MANY_TREES = 100
WIN_BEST = dict(max_depth=4, weight=12, subsample=1.0, eta=0.3)
RUN_EXP_BEST = dict(max_depth=6, weight=4, subsample=1.0, eta=0.3)
RUNS_STATE_BEST = dict(max_depth=3, weight=20, subsample=0.5, eta=0.05, rounds=241)
RUNS_STATLINE_BEST = dict(max_depth=4, weight=12, subsample=1.0, eta=0.1)
SWING_BEST = dict(max_depth=6, weight=16, subsample=1.0, eta=0.5, rounds=67)
_BEST = {"win": WIN_BEST, "run_exp": RUN_EXP_BEST, "runs_state": RUNS_STATE_BEST, "runs_statline": RUNS_STATLINE_BEST, "swing": SWING_BEST}
BB_TYPES = ["fly_ball", "ground_ball", "line_drive", "popup"]
OUTCOME_PROBS = ["prob_1B", "prob_2B", "prob_3B", "prob_HR", "prob_K", "prob_BB",
                 "prob_SF", "prob_out"]


def published(name: str, tune: bool = False) -> dict:
    """Arguments of ``fit_gbt`` as published for a model: the best settings and
    the round ceiling, or (``tune``) the 60-point search with its learning rate."""
    t = TUNING[name]
    if tune:
        return {"grid": dict(t["grid"]), "fixed": dict(t["fixed"]), "max_rounds": t["max_rounds"]}
    return {"fixed": dict(_BEST[name]), "max_rounds": t["max_rounds"]}


@dataclass
class FitResult:
    model: PipelineModel
    params: dict
    rounds: int
    metric: float | None
    grid: list[dict] = field(default_factory=list)
    #: held-out loss of the best constant of the training rows
    constant: float | None = None
    #: what scoring needs besides the pipeline, e.g. the left-out one-hot level
    context: dict[str, str] = field(default_factory=dict)


def save_fit(fit: FitResult, path: str):
    """Pipeline under ``path/pipeline``, context as one row under ``path/context``."""
    from pyspark.sql import SparkSession
    fit.model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(fit.context,)], "context map<string,string>").write.mode("overwrite").parquet(f"{path}/context")


def load_fit(path: str) -> tuple[PipelineModel, dict[str, str]]:
    """(pipeline, context) of ``save_fit``."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/pipeline"), dict(spark.read.parquet(f"{path}/context").first()["context"])


def _stages(features: Sequence[str], nullable: Sequence[str], est):
    stages = []
    imp = [c for c in features if c in nullable]
    if imp:
        # a mean is not a measurement: say which values were missing
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{c}__na`" for c in imp) + " FROM __THIS__"))
        stages.append(Imputer(strategy="mean", inputCols=imp,
                              outputCols=[f"{c}__imp" for c in imp]))
    cols = [f"{c}__imp" if c in imp else c for c in features] + [f"{c}__na" for c in imp]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features"))
    return stages + [est] if est else stages


def _least_rows(kind: str, p: dict) -> int:
    # a logistic node's hessian is at most 1/4 per row, so a weight of w needs
    # at least 4w rows
    return max(1, int(p.get("weight", 1)) * (4 if kind == "classifier" else 1))


def _estimator(kind: str, label: str, p: dict, rounds: int, seed: int):
    common = dict(labelCol=label, featuresCol="features", maxDepth=int(p.get("max_depth", 4)),
                  subsamplingRate=float(p.get("subsample", 1.0)),
                  stepSize=float(p.get("eta", 0.3)), maxIter=int(rounds), seed=seed,
                  maxBins=64, checkpointInterval=BLOCK)
    if kind == "classifier":
        return GBTClassifier(minInstancesPerNode=_least_rows(kind, p), **common)
    return GBTRegressor(minInstancesPerNode=_least_rows(kind, p), lossType="squared", **common)


def _constant_loss(train: DataFrame, valid: DataFrame, label: str, kind: str) -> float | None:
    """Held-out loss of the training mean: squared error, or twice the log loss
    (the loss that boosting reports for labels of -1 and 1)."""
    m = train.agg(F.avg(label)).first()[0]
    if m is None:
        return None
    if kind == "classifier":
        m = min(max(m, 1e-9), 1 - 1e-9)
        loss = -2 * (F.col(label) * math.log(m) + (1 - F.col(label)) * math.log(1 - m))
    else:
        loss = (F.col(label) - m) ** 2
    return valid.agg(F.avg(loss)).first()[0]


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, kind: str = "regressor",
            grid: dict | None = None, fixed: dict | None = None, max_rounds: int = 1000,
            patience: int = PATIENCE, prop: float = 0.75, strata: str | None = None,
            numeric_strata_bins: int | None = 4, key: Sequence[str] | None = None,
            seed: int = 101, parallelism: int = 4, nullable: Sequence[str] = (),
            context: dict[str, str] | None = None) -> FitResult:
    """Tune on a held-out split, then refit on all rows.

    ``grid`` maps max_depth / weight / subsample / eta to candidate lists;
    without a grid the ``fixed`` settings are used.  The rounds of a point are
    those with the least held-out loss; boosting goes on until ``patience``
    more rounds bring nothing better, ``max_rounds`` at most.  All points share
    one written table; ``parallelism`` of them grow side by side in one job
    (``boosting.boost``).  A single point's refit grows along with it and is cut
    at its rounds.  With ``fixed['rounds']`` and no grid nothing is tuned, so
    nothing is fitted but the model itself.

    Where several tasks are needed that cannot exchange sums (executors that
    come and go, a shared folder that is not mounted), MLlib fits as it does,
    a chain of jobs a round (``boosted_losses``).
    """
    spark = df.sparkSession
    shared_dir(spark)  # GBT checkpoints its state every 10 rounds there
    data = df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    fixed, context = dict(fixed or {}), dict(context or {})

    if "rounds" in fixed and not grid:
        params = {k: v for k, v in fixed.items() if k != "rounds"}
        model = _fit_rounds(data.withColumn("is_train", F.lit(1)), features, label, kind, params, int(fixed["rounds"]), seed, nullable)
        return FitResult(model, params, int(fixed["rounds"]), None, context=context)
    key = list(key) if key else []
    strata = strata or label
    if not key:
        data = data.withColumn("_rowkey", F.monotonically_increasing_id())
        key = ["_rowkey"]
    bins = numeric_strata_bins if kind == "regressor" and strata == label else None
    # the split is read by every grid fit: written once to the shared
    # folder, so fits (and recovery from a lost executor) start from it
    split = materialize(stratified_split(data, key, strata, prop, seed=seed, numeric_bins=bins))
    train, valid = split.where("is_train = 1"), split.where("is_train = 0")
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())] if grid else [{}]
    tasks = boosting.task_count(spark, split.count())
    # every point fits the same vectors, imputed by the means of the training rows
    prep = Pipeline(stages=_stages(features, nullable, None)).fit(train)
    model = None
    if tasks and len(points) == 1:
        # the refit has the means of all rows, and its own vectors
        refit = Pipeline(stages=_stages(features, nullable, None)).fit(split)
        both = _vectors(refit, _vectors(prep, split, "_tuned"), "_all").select(label, "is_train", "_tuned", "_all")
        q = fixed
        jobs = [_job(0, kind, q, max_rounds, seed, patience=patience), _job(1, kind, q, max_rounds, seed, all_rows=True, follows=0)]
        (tuned, whole), cuts = boosting.boost(both, label, ["_tuned", "_all"], jobs, tasks)
        results = [_point(q, tuned["losses"])]
        rounds = results[0]["rounds"]
        est = _estimator(kind, label, q, rounds, seed)
        model = PipelineModel(refit.stages + [boosting.as_model(spark, est, whole["trees"][:rounds], cuts[1])])
    elif tasks:
        table = _vectors(prep, split, "features").select(label, "is_train", "features")
        results = []
        for a in range(0, len(points), max(1, parallelism)):
            some = [{**fixed, **p} for p in points[a:a + max(1, parallelism)]]
            got, _ = boosting.boost(table, label, ["features"], [_job(0, kind, q, max_rounds, seed, patience=patience) for q in some], tasks)
            results += [_point(q, g["losses"]) for q, g in zip(some, got)]
    else:
        parts = max(4, split.count() // ROWS_A_TASK)
        table = materialize(prep.transform(split).select(label, "features", "is_train").coalesce(parts))

        def run(p):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", "tuning")  # shared fairly, if so scheduled
            q = {**fixed, **p}
            return _point(q, boosted_losses(table, label, kind, q, max_rounds, patience, seed))

        with ThreadPoolExecutor(max(1, min(parallelism, len(points)))) as ex:
            results = list(ex.map(run, points))
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    best = min(enumerate(results), key=lambda t: (t[1]["metric"], t[0]))[1]
    rounds = int(fixed.get("rounds", best["rounds"]))
    params = {k: v for k, v in best.items() if k not in ("rounds", "metric", "tried")}
    model = model or _fit_rounds(split.drop("_rowkey"), features, label, kind, params, rounds, seed, nullable)
    return FitResult(model, params, rounds, best["metric"], results,
                     _constant_loss(train, valid, label, kind), context)


def _vectors(prep: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``prep``'s vectors under another name, without its other columns."""
    return prep.transform(df).withColumn(name, F.col("features")).select(*df.columns, name)


def _job(vector: int, kind: str, p: dict, rounds: int, seed: int, **more) -> boosting.Job:
    return boosting.Job(vector, {k: v for k, v in p.items() if k != "rounds"}, kind, _least_rows(kind, p), int(rounds), seed, **more)


def _point(q: dict, losses: Sequence[float]) -> dict:
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    return {**q, "rounds": best + 1, "metric": float(losses[best]), "tried": len(losses)}


def _fit_rounds(rows: DataFrame, features: Sequence[str], label: str, kind: str, p: dict, rounds: int, seed: int,
                nullable: Sequence[str]) -> PipelineModel:
    """A fit of all rows with so many rounds.  ``rows`` has ``is_train``."""
    n = rows.count()
    tasks, est = boosting.task_count(rows.sparkSession, n), _estimator(kind, label, p, rounds, seed)
    if not tasks:
        return Pipeline(stages=_stages(features, nullable, est)).fit(rows.drop("is_train").coalesce(max(4, n // ROWS_A_TASK)))
    prep = Pipeline(stages=_stages(features, nullable, None)).fit(rows)
    table = _vectors(prep, rows, "features").select(label, "is_train", "features")
    (got,), cuts = boosting.boost(table, label, ["features"], [_job(0, kind, p, rounds, seed, all_rows=True)], tasks)
    return PipelineModel(prep.stages + [boosting.as_model(rows.sparkSession, est, got["trees"], cuts[0])])


def _until(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds until ``patience`` of them brought nothing better, and whether it came to that."""
    best = 0
    for i, x in enumerate(losses):
        best = i if x < losses[best] else best
        if best + patience <= i:
            return i + 1, True
    return len(losses), False


def boosted_losses(table: DataFrame, label: str, kind: str, params: dict, max_rounds: int, patience: int, seed: int,
                   first: int | None = None) -> list[float]:
    """Held-out loss after each round, until ``patience`` rounds bring nothing
    better (``max_rounds`` at most).  ``table`` has ``features``, ``label`` and
    ``is_train``.

    Each try is one ensemble fit, which bins the rows once and keeps its sums
    from round to round.  If its rounds do not settle it, the next try has
    GROWTH times as many: its first rounds are those of the one before, and all
    tries but the last take less than the last one's rounds together.
    """
    train, valid = table.where("is_train = 1"), table.where("is_train = 0")
    rounds = min(max_rounds, first or 2 * patience)
    while True:
        model = _estimator(kind, label, params, rounds, seed).fit(train)
        losses = model.evaluateEachIteration(valid) if kind == "classifier" else model.evaluateEachIteration(valid, "squared")
        losses = list(losses)
        n, settled = _until(losses, patience)
        if settled or rounds >= max_rounds:
            return losses[:n]
        rounds = max_rounds if 2 * GROWTH * rounds > max_rounds else GROWTH * rounds


def cross_fit_score(df: DataFrame, features: Sequence[str], label: str, name: str,
                    fold_key: str, k: int = 5, kind: str = "regressor",
                    params: dict | None = None, rounds: int = 50, seed: int = 101,
                    nullable: Sequence[str] = (), floor: float | None = None) -> DataFrame:
    """Out-of-fold scores: rows are split into ``k`` folds by a hash of
    ``fold_key`` (e.g. the game), and each fold is scored by a model fitted
    on the other folds, so no row is scored by a model that saw it."""
    fold = F.pmod(F.xxhash64(F.col(fold_key), F.lit(seed)), F.lit(k))
    x = df.withColumn("_fold", fold)
    parts = []
    for i in range(k):
        train = x.where((F.col("_fold") != i) & F.col(label).isNotNull()) \
                 .withColumn(label, F.col(label).cast("double"))
        est = _estimator(kind, label, params or {}, rounds, seed)
        m = Pipeline(stages=_stages(features, nullable, est)).fit(train)
        parts.append(score(m, x.where(F.col("_fold") == i), name, kind, floor))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


def top_grid(fit: FitResult, n: int = 5) -> list[dict]:
    """The ``n`` best grid points by held-out loss (ties: grid order)."""
    order = sorted(range(len(fit.grid)), key=lambda i: (fit.grid[i]["metric"], i))
    return [fit.grid[i] for i in order[:n]]


def score(model: PipelineModel, df: DataFrame, name: str, kind: str = "regressor",
          floor: float | None = None) -> DataFrame:
    """Add the model's prediction (P(label = 1) for a classifier)."""
    last = model.stages[-1]
    if getattr(last, "getNumTrees", 0) > MANY_TREES:
        # MLlib walks a tree's nodes as objects, a row at a time
        boosting.importable(df.sparkSession)
        out = PipelineModel(model.stages[:-1]).transform(df)
        pred = boosting.predicted(boosting.forest(last), F.col("features"), kind == "classifier")
        return _scored(out, pred, name, floor)
    out = model.transform(df)
    if kind == "classifier":
        pred = vector_to_array(F.col("probability"))[1]
    else:
        pred = F.col("prediction")
    return _scored(out, pred, name, floor)


def _scored(out: DataFrame, pred, name: str, floor: float | None) -> DataFrame:
    if floor is not None:
        out, pred = out.withColumn(name, pred), F.col(name)
        pred = F.when(pred < 0, F.lit(floor)).otherwise(pred)
    drop = [c for c in out.columns if c.endswith(("__imp", "__na"))] + ["features", "rawPrediction",
                                                             "probability", "prediction"]
    return out.withColumn(name, pred).drop(*[c for c in drop if c in out.columns])


# ---------------------------------------------------------------- features


def base_state_dummies(df: DataFrame, state: str, drop_level: str | None = None,
                       prefix: str = "base_sit_") -> tuple[DataFrame, list[str]]:
    levels = [s for s in st.BASE_STATES if s != drop_level]
    return one_hot(df, state, levels, prefix=prefix, drop_source=False), \
        [f"{prefix}{s}" for s in levels]


def modal_state(df: DataFrame, state: str) -> str | None:
    """The most frequent state: found on the training frame, kept with the model."""
    from .verbs import modal_level
    row = modal_level(df, state).first()
    return row["_modal"] if row else None


def win_expectancy_features(pa: DataFrame, half: str, rate: str, bat_score: str,
                            fld_score: str, inning: str, outs: str, state: str,
                            drop_level: str | None = "modal") -> tuple[DataFrame, list[str]]:
    """Context of a plate appearance for the win-probability model.

    The base-state one-hot leaves out ``drop_level``.  When scoring, pass the
    level of the training frame (``FitResult.context``); ``'modal'`` finds that
    of this frame.
    """
    if drop_level == "modal":
        drop_level = modal_state(pa, state)
    ctx = st.score_context(bat_score, fld_score, inning)
    x = pa.withColumns({"on_home_team": st.is_home_pitcher(half), "_rate": F.col(rate), **ctx})
    x = x.withColumn("tying_winning_run", st.tying_run_flag("pitcher_score_diff", state))
    x = x.withColumn("walkoff_possibility",
                     st.walkoff_flag(half, "inning_capped", "tying_winning_run"))
    x, dummies = base_state_dummies(x, state, drop_level)
    feats = ["on_home_team", "_rate", "pitcher_score_diff", "abs_score_diff",
             "total_runs_scored", "inning_capped", outs, "tying_winning_run",
             "walkoff_possibility", *dummies]
    return x.withColumns({c: F.col(c).cast("double") for c in feats}), feats


def swing_features(pa: DataFrame, delta: str, probs: Sequence[str] = OUTCOME_PROBS,
                   **ctx) -> tuple[DataFrame, list[str], str]:
    """Size of the win-expectancy swing: |delta| with the context features
    plus the batter's outcome probabilities (imputed by their means)."""
    x, feats = win_expectancy_features(pa, **ctx)
    x = x.withColumn("swing_delta_win_exp", F.abs(F.col(delta)))
    return x, feats + list(probs), "swing_delta_win_exp"


def run_expectancy_features(pa: DataFrame, bat_score: str, post_bat_score: str,
                            hit_distance: str, launch_speed: str, launch_angle: str,
                            speed_angle: str, zone: str, rate: str, state: str, bb_type: str
                            ) -> tuple[DataFrame, list[str], str]:
    """Runs scored on a plate appearance from contact quality and context."""
    x = pa.withColumns({
        "runs_scored": F.col(post_bat_score) - F.col(bat_score),
        "is_400ft": flag(F.col(hit_distance) >= 400),
        "launch_speed_f": F.coalesce(F.col(launch_speed), F.lit(0.0)),
        "below_0_LA": flag(F.col(launch_angle) < 0),
        "barrel": flag(F.col(speed_angle) == 6),
        "batter_woba": F.col(rate),
        "max_runs_possible": st.max_runs_possible(state)})
    x = one_hot(x, bb_type, BB_TYPES, na_level=True, drop_source=False)
    x, dummies = base_state_dummies(x, state)
    x = one_hot(x, zone, ZONES, prefix="attack_zone_", drop_source=False)
    feats = ["is_400ft", "launch_speed_f", "below_0_LA", "barrel", "batter_woba",
             "max_runs_possible", *[f"{bb_type}_{b}" for b in BB_TYPES], f"{bb_type}_NA",
             *dummies, *[f"attack_zone_{z}" for z in ZONES]]
    return x.withColumns({c: F.col(c).cast("double") for c in feats}), feats, "runs_scored"


def runs_allowed_state_features(apps: DataFrame, outs_start: str, state: str, rate: str,
                                entry_count: str) -> tuple[DataFrame, list[str]]:
    """Appearance entry state: outs, runners, double-play and sac-fly
    chances, opponent quality and pitches already thrown."""
    x = apps.where(F.col(outs_start).isNotNull()).withColumns({
        "gidp_possibility": st.gidp_flag(state, outs_start),
        "sac_fly_possibility": st.sac_fly_flag(state, outs_start),
        "pitches_before": F.col(entry_count) - 1})
    x, dummies = base_state_dummies(x, state, prefix="initial_base_sit_")
    feats = [outs_start, "gidp_possibility", "sac_fly_possibility", rate, "pitches_before",
             *dummies]
    return x.withColumns({c: F.col(c).cast("double") for c in feats}), feats


def runs_allowed_statline_features(apps: DataFrame, outs_start: str, state: str, rate: str,
                                   entry_count: str, statline: Sequence[str],
                                   batters_faced: str = "batters_faced"
                                   ) -> tuple[DataFrame, list[str]]:
    """Entry state plus what happened: batters, outs, K, BB, barrels, exit
    velocity, zone shares and batted-ball mix."""
    x, feats = runs_allowed_state_features(apps, outs_start, state, rate, entry_count)
    x = x.withColumn("max_possible_runs", st.max_possible_runs(state, batters_faced))
    more = ["max_possible_runs", *statline]
    return x.withColumns({c: F.col(c).cast("double") for c in more}), feats + more
