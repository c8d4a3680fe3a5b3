"""Model queries: the five feature tables with oracles over all rows, and the
five fits on them; conventions as in ``bindings``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import state as st
from ..functions.zones import ZONES, attack_zone
from ..operators import appearance as app
from ..operators import models, saved, winexp
from ..session import materialize
from .bindings import (_E, _E_COUNTS, _E_SQL, _KEYS, _LS, _ROLLUP_SQL, _SEASON_SQL, _START, _STATE_SQL, _W, _W_SQL, EV_TYPES, _events_as,
                       _sel, _sql_cols, _t, big, r4, register)

_PROBS = [f"prob_{t}" for t in EV_TYPES]
_RE = {
    "hit_distance_sc": "value * 4",
    "launch_angle": "value - 50",
    "plate_x": "(CAST(event_id % 40 AS DOUBLE) - 20) / 12.0",
    "plate_z": "value / 100.0",
}


# ---------------------------------------------------------------- feature tables
def _pa_with_label(spark, d, extra: dict | None = None):
    x = _events_as(spark, d, {**_W, **(extra or {})})
    x = winexp.game_winner_label(x, "game_pk", ["at_bat_number", "pitch_number"],
                                 "post_home_score", "post_away_score")
    x = x.withColumn("pitching_win", winexp.side_win_label("home_win", "inning_topbot"))
    return x.withColumns({"base_state": st.base_state("on_1b", "on_2b", "on_3b"),
                          "outs_when_up": F.col("event_id") % 3})


_CTX = dict(half="inning_topbot", rate="we", bat_score="bat_score", fld_score="fld_score", inning="inning",
            outs="outs_when_up", state="base_state")


def win_rows(spark, d):
    x, feats = models.win_expectancy_features(_pa_with_label(spark, d), **_CTX)
    return x, feats, "pitching_win"


def swing_rows(spark, d):
    x = _pa_with_label(spark, d, {"user_id": "user_id", "season": "CAST(month(ts) AS INT)"})
    x = winexp.delta_win_expectancy(x, "game_pk", "inning_topbot", "at_bat_number", "we",
                                    "post_bat_score", "post_fld_score", "des", pattern="err")
    ev = _t(spark, d, "events").selectExpr("user_id", "CAST(month(ts) AS INT) AS season", "event_type")
    shares = app.zone_share(ev, ["user_id", "season"], "event_type", EV_TYPES, total="_n") \
                .drop("_n").withColumnsRenamed({t: f"prob_{t}" for t in EV_TYPES})
    x = x.join(shares, ["user_id", "season"], "left")
    x, feats, label = models.swing_features(x, "new_delta_win_exp", _PROBS, **_CTX)
    return x.where(F.col(label).isNotNull()), feats, label


def run_exp_rows(spark, d):
    x = _events_as(spark, d, {**_E, **_RE})
    pa = winexp.to_plate_appearance(x, "game_pk", "at_bat_number", "pitch_number")
    pa = pa.withColumns({"base_state": st.base_state("on_1b", "on_2b", "on_3b"),
                         "attack_zone": attack_zone("plate_x", "plate_z", F.lit(3.5), F.lit(1.5))})
    return models.run_expectancy_features(pa, "bat_score", "post_bat_score", "hit_distance_sc", "launch_speed", "launch_angle",
                                          "launch_speed_angle", "attack_zone", "wOBA", "base_state", "bb_type")


def _appearances(spark, d):
    x = _events_as(spark, d, _E)
    t = app.appearance_table(x, x, x.where(F.col("events") == "purchase"), "game_pk", "pitcher",
                             "inning", "inning_topbot", ["at_bat_number", "pitch_number"],
                             "outs_when_up", _START, zone="events", zone_levels=EV_TYPES, count_kwargs=_E_COUNTS)
    return t.withColumn("initial_base_sit", st.base_state("base_1b", "base_2b", "base_3b"))


def runs_state_rows(spark, d):
    x, feats = models.runs_allowed_state_features(_appearances(spark, d), "outs_start", "initial_base_sit", "mean_wOBA",
                                                  "pitch_number_appearance")
    return x, feats, "runs_allowed"


_STATLINE = ["batters_faced", "outs_made", "strikeouts", "walks", "barrels", "avg_exit_velocity", *EV_TYPES, "BIP", "GB", "LD", "FB", "Pop"]


def runs_statline_rows(spark, d):
    x, feats = models.runs_allowed_statline_features(_appearances(spark, d), "outs_start", "initial_base_sit", "mean_wOBA",
                                                     "pitch_number_appearance", _STATLINE)
    return x, feats, "runs_allowed"


def _features_out(rows, key, levels=()):
    """Key, features and label; a left-out one-hot level is a NULL column."""
    x, feats, label = rows
    gone = [c for c in levels if c not in feats]
    return x.select(*[big(k).alias(k) for k in key], *[r4(c).alias(c.lstrip("_")) for c in dict.fromkeys([*feats, label])],
                    *[F.lit(None).cast("double").alias(c) for c in gone])


_n = lambda x, name: f"round(CAST({x} AS DOUBLE), 4) + 0.0 AS {name}"
_ON = "length(replace(base_state, '_', ''))"
_CTX_SQL = ", ".join([
    _n("inning_topbot = 'Top'", "on_home_team"), _n("we", "rate"), _n("fld_score - bat_score", "pitcher_score_diff"),
    _n("abs(fld_score - bat_score)", "abs_score_diff"), _n("bat_score + fld_score", "total_runs_scored"),
    _n("least(inning, 10)", "inning_capped"), _n("event_id % 3", "outs_when_up"), _n("tying", "tying_winning_run"),
    _n("tying AND inning >= 9 AND inning_topbot = 'Bot'", "walkoff_possibility"),
    *[_n(f"CASE WHEN modal <> '{s}' THEN base_state = '{s}' END", f'"base_sit_{s}"') for s in st.BASE_STATES]])
#: the game's winner on its last play; the state; whether the tying run is up
_LABELLED_SQL = f"""
b AS (SELECT {_W_SQL}, user_id, month(ts) AS season FROM events),
w AS (SELECT game_pk, arg_max(post_home_score > post_away_score, at_bat_number) AS home FROM b GROUP BY game_pk),
s AS (SELECT b.*, CAST(home = (inning_topbot = 'Top') AS INTEGER) AS pitching_win, {_STATE_SQL} AS base_state FROM b JOIN w USING (game_pk)),
c AS (SELECT *, coalesce(fld_score - bat_score BETWEEN 0 AND {_ON} + 1, false) AS tying FROM s),
md AS (SELECT base_state AS modal FROM {{modal_of}} GROUP BY 1 ORDER BY count(*) DESC, base_state LIMIT 1)"""


@register("features_win", f"""WITH {_LABELLED_SQL.format(modal_of='s')}
SELECT event_id, {_CTX_SQL}, {_n('pitching_win', 'pitching_win')} FROM c, md""")
def q_features_win(spark, d):
    """D15, and the one-hot without its modal level in wide form (R4)."""
    return _features_out(win_rows(spark, d), ["event_id"], [f"base_sit_{s}" for s in st.BASE_STATES])


@register("features_swing", f"""WITH {_LABELLED_SQL.format(modal_of='s')},
l AS (SELECT *, lead(we) OVER (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number) AS nh,
        lead(we) OVER (PARTITION BY game_pk ORDER BY at_bat_number) AS ng,
        at_bat_number = max(at_bat_number) OVER (PARTITION BY game_pk) AS is_end,
        CASE sign(post_fld_score - post_bat_score) WHEN 1 THEN 1 WHEN -1 THEN 0 ELSE CASE WHEN contains(des, 'err') THEN 0 END END AS result FROM c),
e AS (SELECT *, abs(coalesce(CASE WHEN is_end THEN result END, nh, CASE WHEN NOT is_end THEN 1 - ng END) - we) AS swing_delta_win_exp FROM l),
h AS (SELECT user_id, month(ts) AS season, {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') / count(*) AS prob_{t}" for t in EV_TYPES)}
      FROM events GROUP BY 1, 2)
SELECT event_id, {_CTX_SQL}, {", ".join(_n(p, p) for p in _PROBS)}, {_n('swing_delta_win_exp', 'swing_delta_win_exp')}
FROM e JOIN h USING (user_id, season), md WHERE swing_delta_win_exp IS NOT NULL""")
def q_features_swing(spark, d):
    return _features_out(swing_rows(spark, d), ["event_id"], [f"base_sit_{s}" for s in st.BASE_STATES])


_BB_TYPES = models.BB_TYPES


@register("features_run_expectancy", f"""
WITH b AS (SELECT event_id, {_sql_cols({**_E, **_RE})} FROM events),
s AS (SELECT *, {_STATE_SQL} AS base_state, plate_x * 12 AS x, (plate_z * 12 - 30) / 12 * 100 AS pct FROM b),
z AS (SELECT *, CASE WHEN abs(x) <= 6.7 AND abs(pct) <= 67 THEN 'Heart' WHEN abs(x) <= 13.3 AND abs(pct) <= 133 THEN 'Shadow'
        WHEN abs(x) > 13.3 + 6.6 OR abs(pct) > 200 THEN 'Waste' ELSE 'Chase' END AS zone FROM s)
SELECT event_id, {_n('hit_distance_sc >= 400', 'is_400ft')}, {_n('coalesce(launch_speed, 0)', 'launch_speed_f')}, {_n('launch_angle < 0', 'below_0_LA')},
  {_n('launch_speed_angle = 6', 'barrel')}, {_n('wOBA', 'batter_woba')}, {_n(f'{_ON} + 1', 'max_runs_possible')},
  {", ".join(_n(f"coalesce(bb_type = '{k}', false)", f"bb_type_{k}") for k in _BB_TYPES)}, {_n('bb_type IS NULL', 'bb_type_NA')},
  {", ".join(_n(f"base_state = '{k}'", f'"base_sit_{k}"') for k in st.BASE_STATES)},
  {", ".join(_n(f"zone = '{k}'", f"attack_zone_{k}") for k in ZONES)}, {_n('post_bat_score - bat_score', 'runs_scored')}
FROM z""")
def q_features_run_expectancy(spark, d):
    return _features_out(run_exp_rows(spark, d), ["event_id"])


_FIRST = ", ".join(f"first(on_{b}b ORDER BY at_bat_number) AS on_{b}b" for b in (1, 2, 3))
_ENTRY_SQL = f"""WITH {_ROLLUP_SQL},
f AS (SELECT game_pk, pitcher, inning, {_FIRST} FROM b GROUP BY ALL),
k AS (SELECT *, {_STATE_SQL} AS base_state FROM st JOIN f USING (game_pk, pitcher, inning) JOIN ct USING (game_pk, pitcher, inning)
      JOIN en USING (game_pk, pitcher, inning)
      WHERE outs_start IS NOT NULL AND (game_pk, pitcher, inning) IN (SELECT (game_pk, pitcher, inning) FROM b WHERE events = 'purchase')),
l AS (SELECT *, lead(outs_when_up) OVER (PARTITION BY game_pk, inning, inning_topbot ORDER BY at_bat_number) AS nx FROM b),
o AS (SELECT game_pk, pitcher, inning, sum(CASE WHEN nx IS NULL THEN 3 - outs_when_up ELSE nx - outs_when_up END) AS outs_made,
        {", ".join(f"count(*) FILTER (WHERE events = '{t}') / count(*) AS {t}" for t in EV_TYPES)} FROM l GROUP BY game_pk, pitcher, inning)"""
_ENTRY_COLS = ", ".join([
    *[f"CAST({k} AS BIGINT) AS {k}" for k in _KEYS], _n("outs_start", "outs_start"),
    _n("contains(base_state, '1') AND outs_start < 2", "gidp_possibility"), _n("contains(base_state, '3') AND outs_start < 2", "sac_fly_possibility"),
    _n("mean_wOBA", "mean_wOBA"), _n("pitch_number_appearance - 1", "pitches_before"),
    *[_n(f"base_state = '{s}'", f'"initial_base_sit_{s}"') for s in st.BASE_STATES], _n("runs_allowed", "runs_allowed")])


@register("features_runs_state", f"{_ENTRY_SQL} SELECT {_ENTRY_COLS} FROM k")
def q_features_runs_state(spark, d):
    return _features_out(runs_state_rows(spark, d), _KEYS)


@register("features_runs_statline", f"""{_ENTRY_SQL}
SELECT {_ENTRY_COLS}, {_n(f'{_ON} + batters_faced', 'max_possible_runs')}, {", ".join(_n(c, c) for c in _STATLINE)}
FROM k JOIN o USING (game_pk, pitcher, inning)""")
def q_features_runs_statline(spark, d):
    return _features_out(runs_statline_rows(spark, d), _KEYS)


# ---------------------------------------------------------------- fits
def _label_bounds(df, label: str) -> tuple[float, float]:
    """A boosted sum may pass the labels, but not by more than their range."""
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    return lo - (hi - lo), hi + (hi - lo)


def _fitted(rows, name: str, key, nullable=(), kind="regressor", prop=0.75, floor=None, bounds=None):
    """The published settings: learning rate, patience, round ceiling; the
    rounds are those of the least held-out loss.  Each row: the key, whether
    there is a prediction, whether it lies within the bounds, and whether the
    held-out loss is below that of the best constant."""
    x, feats, label = rows
    # the split, the means, the bounds and the scoring all read them: made once
    x = materialize(x.select(*dict.fromkeys([*key, *feats, label])))
    how = models.published(name)
    how["fixed"] = {k: v for k, v in how["fixed"].items() if k != "rounds"}
    fit = models.fit_gbt(x, feats, label, kind=kind, prop=prop, key=key, nullable=nullable, **how)
    out = models.score(fit.model, x, "_p", kind=kind, floor=floor)
    lo, hi = bounds or _label_bounds(x, label)
    return out.select(*[big(k).alias(k) for k in key], F.col("_p").isNotNull().alias("has_prediction"),
                      F.col("_p").between(lo, hi).alias("in_bounds"), F.lit(fit.metric < fit.constant).alias("beats_constant"))


_CHECKED_SQL = "true AS has_prediction, true AS in_bounds, true AS beats_constant"
_APP_ROWS_SQL = f"{_ENTRY_SQL} SELECT {', '.join(_KEYS)}, {_CHECKED_SQL} FROM k"


@register("gbt_classify", f"SELECT event_id, {_CHECKED_SQL} FROM events")
def q_gbt_classify(spark, d):
    """D15: win expectancy of the fielding side."""
    return _fitted(win_rows(spark, d), "win", ["event_id"], kind="classifier", prop=0.65, bounds=(0, 1))


@register("gbt_regress", _APP_ROWS_SQL)
def q_gbt_regress(spark, d):
    """D28: runs allowed by an appearance from its entry state."""
    return _fitted(runs_state_rows(spark, d), "runs_state", _KEYS, ["mean_wOBA"])


@register("gbt_swing", f"""
WITH b AS (SELECT {_W_SQL} FROM events),
l AS (SELECT event_id, we,
        lead(we) OVER (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number) AS nh,
        lead(we) OVER (PARTITION BY game_pk ORDER BY at_bat_number) AS ng,
        at_bat_number = max(at_bat_number) OVER (PARTITION BY game_pk) AS is_end,
        post_fld_score <> post_bat_score OR contains(des, 'err') AS decided FROM b)
SELECT event_id, {_CHECKED_SQL} FROM l
WHERE we IS NOT NULL AND (is_end AND decided OR nh IS NOT NULL OR NOT is_end AND ng IS NOT NULL)""")
def q_gbt_swing(spark, d):
    """D17: size of the win-expectancy swing from context + batter outcome
    shares (per user and month, mean-imputed), floored at 0.001."""
    return _fitted(swing_rows(spark, d), "swing", ["event_id"], _PROBS, prop=0.65, floor=0.001)


@register("gbt_run_expectancy", f"SELECT event_id, {_CHECKED_SQL} FROM events")
def q_gbt_run_expectancy(spark, d):
    """D18: runs scored on a plate appearance from contact quality,
    zone, batter rate, runners and batted-ball type."""
    return _fitted(run_exp_rows(spark, d), "run_exp", ["event_id"], ["is_400ft", "below_0_LA"])


@register("gbt_runs_statline", _APP_ROWS_SQL)
def q_gbt_runs_statline(spark, d):
    """D29: runs allowed by an appearance from its entry state and statline."""
    return _fitted(runs_statline_rows(spark, d), "runs_statline", _KEYS, ["mean_wOBA", "outs_made"])


# ---------------------------------------------------------------- J3: three keys; D33: centred trim
_REL = ["game_pk", "at_bat_number", "pitch_number"]


@register("relief_join", f"""
WITH b AS (SELECT {_W_SQL} FROM events),
r AS (SELECT game_pk, at_bat_number, pitch_number, xr FROM b WHERE events IN ('purchase', 'click')),
w AS (SELECT game_pk, at_bat_number, pitch_number, swing FROM b WHERE inning <= 20),
j AS (SELECT r.*, w.swing FROM r LEFT JOIN w USING (game_pk, at_bat_number, pitch_number)),
m AS (SELECT avg(abs(swing)) AS ma FROM j)
SELECT CAST(game_pk AS BIGINT) AS game_pk, CAST(at_bat_number AS BIGINT) AS at_bat_number, CAST(pitch_number AS BIGINT) AS pitch_number,
       {_n('xr', 'run_expectancy')}, {_n('abs(swing) / ma', 'leverage')} FROM j, m""")
def q_relief_join(spark, d):
    """Relief plate appearances with their swing, joined on three keys; the
    index is relative to those appearances."""
    x = _events_as(spark, d, _W)
    rel = x.where(F.col("events").isin("purchase", "click")).select(*_REL, "xr")
    j = rel.join(x.where("inning <= 20").select(*_REL, "swing"), _REL, "left")
    return winexp.leverage_index(j, "swing").select(*[big(k).alias(k) for k in _REL], r4("xr").alias("run_expectancy"), r4("leverage").alias("leverage"))


@register("season_trimmed_centered", f"""
WITH a0 AS (SELECT {_sql_cols(_LS)} FROM lineitem),
a AS (SELECT * REPLACE (actual_rapo - (SELECT avg(actual_rapo) FROM a0) AS actual_rapo,
                        expected_rapo - (SELECT avg(expected_rapo) FROM a0) AS expected_rapo) FROM a0),
q AS (SELECT pitcher, game_year, quantile_cont(actual_rapo, 0.05) AS q5, quantile_cont(actual_rapo, 0.95) AS q95 FROM a GROUP BY pitcher, game_year),
t AS (SELECT a.* FROM a JOIN q USING (pitcher, game_year) WHERE actual_rapo < q95 AND actual_rapo > q5),
{_SEASON_SQL.format(src='t').replace("count(*) > 1", "count(*) > 25")}
SELECT pitcher, CAST(game_year AS BIGINT) AS game_year, CAST(appearances AS BIGINT) AS appearances, CAST(som AS BIGINT) AS outs_made,
       {_n('actual_rapo_season', 'actual_rapo_season')}, {_n('expected_rapo_season', 'expected_rapo_season')},
       {_n('actual_rapo_season - expected_rapo_season', 'diff')}
FROM s WHERE actual_rapo_season IS NOT NULL AND expected_rapo_season IS NOT NULL""")
def q_season_trimmed_centered(spark, d):
    x = _t(spark, d, "lineitem").selectExpr(*_sel(_LS))
    s = saved.trimmed_season_runs_saved(x, "pitcher", "game_pk", "game_year", "outs_made", center=True)
    return s.select("pitcher", *[big(c).alias(c) for c in ("game_year", "appearances", "outs_made")],
                    *[r4(c).alias(c) for c in ("actual_rapo_season", "expected_rapo_season", "diff")])
