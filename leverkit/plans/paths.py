"""The three end-to-end analyses on game data, composed from the operators.

Column names are those of pitch-by-pitch game data (``game_pk``,
``at_bat_number``, ``pitch_number``, ``inning_topbot``, ``on_1b`` ...).
Each function returns a dict of DataFrames (every intermediate a user may
want to keep); writing them is left to ``leverkit.sources.io``.

* ``leverage_path``  - batter rates -> win expectancy model -> change in
  win expectancy -> swing model -> run expectancy model -> leverage,
  leverage credit -> season LPAA with ranks.
* ``runs_saved_path`` - appearance table -> two run-allowance models ->
  runs saved -> season and trimmed season tables -> persistence.
* ``rest_path`` - outings of two leagues -> days of rest -> rest profile
  and entropy -> career-weighted runs saved, and runs saved by rest.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import state as st
from ..functions.zones import attack_zone
from ..operators import appearance as app
from ..operators import models, persist, rest, saved, winexp
from ..session import materialize
from ..sources import io

GAME_ORDER = ["at_bat_number", "pitch_number"]
APP_KEYS = ["game_pk", "pitcher", "inning"]


def leverage_path(pitches: DataFrame, relief_pa: DataFrame, probs: DataFrame | None = None,
                  names: DataFrame | None = None, min_pa: int = 100,
                  tune: bool = False, pa_table: str | None = None, buckets: int = 200,
                  **fit_args) -> dict[str, DataFrame]:
    """Path A.  The models are fitted with the published settings, or with
    ``tune`` searched over the published grids; ``fit_args`` go to every
    ``fit_gbt`` on top.  ``pa_table`` writes the plate appearances as a table
    of that name, in ``buckets`` buckets by game, so that no later step of a
    game moves them again.  ``relief_pa`` holds the plate appearances to credit (same
    columns as ``pitches``, one row per PA); ``probs`` optional per
    (batter, game_year) outcome probabilities; ``names`` (pitcher,
    player_name)."""
    woba = winexp.batter_season_rate(pitches, "batter", "game_year", "events",
                                     "woba_value", "woba_denom")
    woba_b = woba.withColumnRenamed("wOBA", "batter_season_wOBA")
    x = winexp.attach_game_context(pitches, "game_pk", "inning_topbot", GAME_ORDER, "pitcher",
                                   "home_score", "away_score")
    x = x.withColumns({"pitching_win": winexp.side_win_label("home_win", "inning_topbot"),
                       "base_sit": st.base_state("on_1b", "on_2b", "on_3b")})
    x = x.join(woba_b, ["batter", "game_year"], "left")
    pa = winexp.to_plate_appearance(x, "game_pk", "at_bat_number", "pitch_number")
    # by game in the warehouse, the leads below find each game in one place
    pa = io.write_bucketed(pa, pa_table, ["game_pk"], buckets, GAME_ORDER) if pa_table else materialize(pa)
    level = models.modal_state(pa, "base_sit")
    ctx = dict(drop_level=level, half="inning_topbot", rate="batter_season_wOBA", bat_score="bat_score",
               fld_score="fld_score", inning="inning", outs="outs_when_up", state="base_sit")
    wdf, wfeats = models.win_expectancy_features(pa, **ctx)
    wfit = models.fit_gbt(wdf, wfeats, "pitching_win", kind="classifier",
                          prop=0.65,
                          key=["game_pk", "at_bat_number"], nullable=["_rate"],
                          context={"drop_level": level or ""}, **{**models.published("win", tune), **fit_args})
    we = models.score(wfit.model, wdf, "updated_pitcher_win_exp", kind="classifier")
    delta = winexp.delta_win_expectancy(we, "game_pk", "inning_topbot", "at_bat_number",
                                        "updated_pitcher_win_exp", "post_bat_score",
                                        "post_fld_score", "des")
    prob_cols: list[str] = []
    if probs is not None:
        prob_cols = [c for c in models.OUTCOME_PROBS if c in probs.columns]
        delta = delta.join(probs.select("batter", "game_year", *prob_cols),
                           ["batter", "game_year"], "left")
    sdf, sfeats, slabel = models.swing_features(delta, "new_delta_win_exp", prob_cols, **ctx)
    sfeats_null = ["_rate", *prob_cols]
    # a plate appearance without a change has no swing and takes no part in the mean
    sdf = sdf.where(F.col(slabel).isNotNull())
    sfit = models.fit_gbt(sdf, sfeats, slabel,
                          prop=0.65,
                          key=["game_pk", "at_bat_number"], nullable=sfeats_null,
                          context={"drop_level": level or ""}, **{**models.published("swing", tune), **fit_args})
    swing = models.score(sfit.model, sdf, "ab_win_expect", floor=0.001)
    # run expectancy of a plate appearance, trained on all PAs
    pz = pa.withColumn("attack_zone", attack_zone("plate_x", "plate_z", "sz_top", "sz_bot"))
    rdf, rfeats, rlabel = models.run_expectancy_features(
        pz, "bat_score", "post_bat_score", "hit_distance_sc", "launch_speed", "launch_angle",
        "launch_speed_angle", "attack_zone", "batter_season_wOBA", "base_sit", "bb_type")
    rfit = models.fit_gbt(rdf, rfeats, rlabel, 
                          key=["game_pk", "at_bat_number"],
                          nullable=["is_400ft", "below_0_LA", "barrel", "batter_woba"], **{**models.published("run_exp", tune), **fit_args})
    # relief PAs: scored run expectancy joined to the swing (leverage) table
    rel = relief_pa.join(woba_b, ["batter", "game_year"], "left") \
                   .withColumns({"base_sit": st.base_state("on_1b", "on_2b", "on_3b"),
                                 "attack_zone": attack_zone("plate_x", "plate_z", "sz_top",
                                                            "sz_bot")})
    rel_f, _, _ = models.run_expectancy_features(
        rel, "bat_score", "post_bat_score", "hit_distance_sc", "launch_speed", "launch_angle",
        "launch_speed_angle", "attack_zone", "batter_season_wOBA", "base_sit", "bb_type")
    rel_x = models.score(rfit.model, rel_f, "run_expectancy_saves") \
                  .select("game_pk", "at_bat_number", "pitch_number", "run_expectancy_saves")
    keep = ["game_pk", "at_bat_number", "pitch_number", "game_year", "pitcher", "inning",
            "inning_topbot", "bat_score", "fld_score", "post_home_score", "post_away_score",
            "bat_score_diff", "events", "base_sit", "ab_win_expect"]
    # the index is relative to the relief appearances, not to all
    credit_in = rel_x.join(swing.select(*keep), ["game_pk", "at_bat_number", "pitch_number"], "left")
    credit_in = materialize(winexp.leverage_index(credit_in, "ab_win_expect"))
    credit = winexp.leverage_credit(credit_in, "game_pk", "at_bat_number", "pitch_number",
                                    "inning_topbot", "inning", "bat_score", "fld_score",
                                    "post_home_score", "post_away_score", "bat_score_diff",
                                    "leverage", "base_sit", "run_expectancy_saves", "events")
    named = credit.join(names, "pitcher", "left") if names is not None else \
        credit.withColumn("player_name", F.lit(None).cast("string"))
    lpaa = winexp.season_leverage_total(named, "pitcher", "player_name", "game_year",
                                        "LI_diff", min_n=min_pa)
    return {"batter_woba": woba, "win_exp": we, "delta": delta, "swing": swing,
            "leverage": credit_in, "credit": credit, "season_lpaa": lpaa,
            "models": {"win": wfit, "swing": sfit, "run_exp": rfit}}


def runs_saved_path(pitches: DataFrame, relief_pa: DataFrame, woba: DataFrame,
                    names: DataFrame | None = None, min_games: int = 25,
                    tune: bool = False, **fit_args) -> dict[str, DataFrame]:
    """Path B.  ``woba`` is the (batter, game_year, wOBA) lookup; ``fit_args``
    as in path A."""
    p = pitches.withColumn("attack_zone", attack_zone("plate_x", "plate_z", "sz_top", "sz_bot"))
    pa = winexp.to_plate_appearance(p, "game_pk", "at_bat_number", "pitch_number", dedup=False)
    pa = pa.join(woba, ["batter", "game_year"], "left")
    start = {"outs_start": "outs_when_up", "base_1b": "on_1b", "base_2b": "on_2b",
             "base_3b": "on_3b"}
    t = app.appearance_table(p, pa, relief_pa, "game_pk", "pitcher", "inning", "inning_topbot",
                             GAME_ORDER, "outs_when_up", start, zone="attack_zone")
    # an appearance without a start state takes no part: it would make its whole
    # game's and season's sums unknown
    t = t.where(F.col("outs_start").isNotNull())
    t = materialize(t.withColumn("initial_base_sit", st.base_state("base_1b", "base_2b",
                                                                    "base_3b")))
    a1, f1 = models.runs_allowed_state_features(t, "outs_start", "initial_base_sit",
                                                "mean_wOBA", "pitch_number_appearance")
    m1 = models.fit_gbt(a1, f1, "runs_allowed", key=APP_KEYS,
                        nullable=["mean_wOBA"], **{**models.published("runs_state", tune), **fit_args})
    statline = ["batters_faced", "outs_made", "strikeouts", "walks", "barrels",
                "avg_exit_velocity", "Chase", "Heart", "Shadow", "Waste", "BIP", "GB", "LD",
                "FB", "Pop"]
    a2, f2 = models.runs_allowed_statline_features(t, "outs_start", "initial_base_sit",
                                                   "mean_wOBA", "pitch_number_appearance",
                                                   statline)
    m2 = models.fit_gbt(a2, f2, "runs_allowed", key=APP_KEYS,
                        nullable=["mean_wOBA", "outs_made"], **{**models.published("runs_statline", tune), **fit_args})
    s1 = models.score(m1.model, a1, "runs_bs").select(*APP_KEYS, "runs_bs")
    s2 = models.score(m2.model, a2, "exp_runs_allowed").select(*APP_KEYS, "exp_runs_allowed")
    years = pitches.select("game_pk", "game_year").distinct()
    apps = t.join(s1, APP_KEYS, "left").join(s2, APP_KEYS, "left").join(years, "game_pk", "left")
    apps = saved.runs_saved(apps, "runs_bs", "runs_allowed", "exp_runs_allowed")
    season = saved.season_runs_saved(apps, "pitcher", "game_pk", "game_year", "outs_made",
                                     min_appearances=min_games, lookup=names)
    trimmed = saved.trimmed_season_runs_saved(apps, "pitcher", "game_pk", "game_year",
                                              "outs_made", min_appearances=min_games,
                                              lookup=names)
    lagged = persist.prior_season_lag(trimmed, "pitcher", "game_year",
                                      ["actual_rapo_season", "expected_rapo_season"])
    return {"appearances": apps, "season": season, "season_trimmed": trimmed,
            "state_mean": saved.state_mean(apps, ["initial_base_sit", "outs_start"], "runs_bs"),
            "persistence_input": lagged,
            "persistence": persist.stickiness(lagged, "prev_actual_rapo_season",
                                              "actual_rapo_season"),
            "models": {"state": m1, "statline": m2}}


def rest_path(mlb_pa: DataFrame, aaa_plays: DataFrame, apps_with_saved: DataFrame,
              season_trimmed: DataFrame, names: DataFrame | None = None,
              season_after=None, min_season=None) -> dict[str, DataFrame]:
    """Path C.  ``aaa_plays`` carries (game_pk, game_date, `matchup.pitcher.id`)."""
    mlb = rest.outings(mlb_pa, "pitcher", "game_date", "game_pk", "game_year")
    aaa = aaa_plays.select("game_pk", "game_date",
                           F.col("`matchup.pitcher.id`").alias("pitcher"),
                           F.year("game_date").alias("game_year"))
    outs = rest.unify_outings(mlb, aaa, "pitcher")
    days = materialize(rest.days_of_rest(outs, "pitcher", "game_year", "game_date", "game_pk"))
    profile = rest.rest_profile(days, "pitcher", "game_year", "game_date",
                                season_after=season_after)
    seasons = season_trimmed if min_season is None else \
        season_trimmed.where(F.col("game_year") >= min_season)
    career = rest.career_weighted_metric(seasons, "pitcher",
                                         ["actual_rapo_season", "expected_rapo_season"],
                                         "appearances", profile.select("pitcher", "entropy"),
                                         product_of="actual_rapo_season",
                                         product_name="rapo_entropy")
    perf = rest.rest_bucket_performance(apps_with_saved, days, "pitcher", "game_pk",
                                        "game_year", "game_date", "runs_bs", "runs_allowed",
                                        "exp_runs_allowed", "outs_made",
                                        season_after=season_after)
    if names is not None:
        profile = profile.join(names, "pitcher", "left")
        career = career.join(names, "pitcher", "left")
        perf = perf.join(names, "pitcher", "left")
    return {"rest_days": days, "rest_profile": profile, "career": career,
            "rest_performance": perf, "rest_slices": rest.rest_bucket_slices(perf)}


def write_outputs(results: dict, out_dir: str, fmt: str = "parquet",
                  season: str = "game_year") -> list[str]:
    """Write every DataFrame of a path's result dict under ``out_dir``
    (nested dicts become sub-folders; fitted models are saved as
    pipelines).  Parquet tables with a season column are partitioned by it,
    so later reads of one season prune the rest.  Returns the paths."""
    import os

    from pyspark.sql import DataFrame as _DF

    from ..operators.models import FitResult, save_fit

    written = []
    for name, value in results.items():
        path = os.path.join(out_dir, name)
        if isinstance(value, dict):
            written += write_outputs(value, path, fmt, season)
        elif isinstance(value, FitResult):
            save_fit(value, path)
            written.append(path)
        elif isinstance(value, _DF):
            if fmt == "csv":
                io.write_csv(value, path)
            else:
                parts = [season] if season in value.columns else []
                io.write_parquet(value, path, partition_by=parts)
            written.append(path)
    return written
