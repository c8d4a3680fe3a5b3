"""Win expectancy labels, its per-play change, leverage and leverage credit."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import flag, in_set, ratio_or_zero, zsum
from ..functions.state import max_runs_possible
from ..plans.ordered import has_heavy_groups, lead_in_group, row_number_in_group
from .verbs import center, describe_quantiles, join_keys_null_safe, scalar_aggs, scale_by_mean_abs, top_ties


def to_plate_appearance(pitches: DataFrame, game: str, at_bat: str, pitch: str,
                        dedup: bool = True) -> DataFrame:
    """Last pitch of each plate appearance (ties kept, optional distinct)."""
    return top_ties(pitches, [game, at_bat], pitch, dedup=dedup)


def batter_season_rate(pitches: DataFrame, batter: str, season: str, event: str,
                       value: str, denom: str, name: str = "wOBA") -> DataFrame:
    """Sum(value) / sum(denom) over rows with a non-NULL event, per
    (batter, season); 0 when the denominator sums to 0."""
    x = pitches.where(F.col(event).isNotNull())
    g = x.groupBy(batter, season).agg(zsum(value).alias("_v"), zsum(denom).alias("_d"))
    return g.select(batter, season, ratio_or_zero("_v", "_d").alias(name))


def game_winner_label(pitches: DataFrame, game: str, order: Sequence[str],
                      home_score: str, away_score: str,
                      name: str = "home_win") -> DataFrame:
    """1 when the home side leads on the game's last pitch, joined to
    every row of the game (0 on a tie; NULL score -> NULL)."""
    last = top_ties(pitches.select(game, *order, home_score, away_score), [game], list(order))
    lab = last.select(home_score, away_score, game).distinct() \
              .select(game, flag(F.col(home_score) > F.col(away_score)).alias(name))
    return pitches.join(lab, game, "left")


def side_win_label(home_win: str, half: str, name: str = "pitching_win",
                   top: str = "Top", bottom: str = "Bot") -> Column:
    """Did the fielding side win?  The home side fields in the top half, so it
    won where "home won" and "top half" are both true or both false."""
    hw, h = F.col(home_win), F.col(half)
    return F.when(hw.isin(0, 1) & h.isin(top, bottom), ((hw == 1) == (h == top)).cast("int")).alias(name)


def starter_id(pitches: DataFrame, by: Sequence[str], order: Sequence[str],
               pitcher: str, name: str = "sp") -> DataFrame:
    """First pitcher of each (game, half) in pitch order, on every row.
    ``min_by`` is a partial aggregate, so a hot game never sits in one task."""
    first = pitches.groupBy(*by).agg(
        F.min_by(F.col(pitcher), F.struct(*[F.col(o) for o in order])).alias(name))
    return join_keys_null_safe(pitches, first, list(by), "left")


def attach_game_context(pitches: DataFrame, game: str, half: str, order: Sequence[str],
                        pitcher: str, home_score: str, away_score: str,
                        label: str = "home_win", sp: str = "sp") -> DataFrame:
    """``game_winner_label`` and ``starter_id`` in one join on the game.

    Both are per-game facts (the starters as a short list of (half,
    pitcher) pairs, NULL half included), so the fact table is shuffled
    once, by game, instead of once per key set.
    """
    last = top_ties(pitches.select(game, *order, home_score, away_score), [game], list(order))
    lab = last.select(home_score, away_score, game).distinct() \
              .select(game, flag(F.col(home_score) > F.col(away_score)).alias(label))
    starts = (pitches.groupBy(game, half)
                     .agg(F.min_by(F.col(pitcher), F.struct(*[F.col(o) for o in order]))
                          .alias("_sp"))
                     .groupBy(game)
                     .agg(F.collect_list(F.struct(F.col(half).alias("h"),
                                                  F.col("_sp").alias("p"))).alias("_starts")))
    per_game = lab.join(starts, game, "full")
    out = pitches.join(per_game, game, "left")
    pick = F.filter("_starts", lambda x: x["h"].eqNullSafe(F.col(half)))
    return out.withColumn(sp, F.element_at(pick, 1)["p"]).drop("_starts")


def delta_win_expectancy(pa: DataFrame, game: str, half: str, at_bat: str, we: str,
                         post_bat: str, post_fld: str, des: str,
                         pattern: str = "balk", name: str = "new_delta_win_exp") -> DataFrame:
    """Change in the fielding side's win expectancy over each plate appearance:
    what the expectancy becomes, less what it was.

    It becomes the next PA's in the same half; after the half's last PA, the
    complement of the game's next PA (the other side is fielding); after the
    game's last PA, the result: 1 for a lead of the fielding side, 0 for a
    deficit or if the description has ``pattern``.
    """
    # one probe on the game settles the (game, half) groups too
    light = not has_heavy_groups(pa, [game])
    x = lead_in_group(pa, [game, half], [at_bat], [we], prefix="_nh_", assume_light=light)
    x = lead_in_group(x, [game], [at_bat], [we], prefix="_ng_",
                      group_aggs={"_end": F.max(at_bat)}, assume_light=light)
    over = F.col(at_bat) == F.col("_end")
    lost = (F.col(post_fld) < F.col(post_bat)) | F.col(des).contains(pattern)
    result = F.when(F.col(post_fld) > F.col(post_bat), F.lit(1.0)).when(lost, F.lit(0.0))
    becomes = F.coalesce(F.when(over, result), F.col(f"_nh_{we}"),
                         F.when(~over, 1 - F.col(f"_ng_{we}")))
    return x.withColumn(name, becomes - F.col(we)).drop(f"_nh_{we}", f"_ng_{we}", "_end")


def leverage_index(df: DataFrame, swing: str, name: str = "leverage") -> DataFrame:
    """abs(swing) / mean(abs(swing)) over the whole table (mean is 1)."""
    return scale_by_mean_abs(df, swing, name)


def leverage_summary(df: DataFrame, swing: str, prefix: str = "") -> DataFrame:
    """``describe_quantiles`` of the leverage index: that of abs(swing), divided
    by its mean, so the table is not scaled first."""
    d = describe_quantiles(df.select(F.abs(F.col(swing)).alias("_a")), "_a", prefix)
    keep = f"{prefix}n_null"
    return d.select(*[(F.col(c) if c == keep else F.col(c) / F.col(f"{prefix}mean")).alias(c) for c in d.columns])


def clamp_run_expectancy(xr: str, state: str, events: str,
                         walk_events: Sequence[str] = ("walk", "hit_by_pitch")) -> Column:
    """Clamp to [0, 4]; a bases-loaded walk or hit-by-pitch is exactly 1."""
    x = F.col(xr)
    return (F.when(x < 0, F.lit(0.0)).when(x > 4, F.lit(4.0))
             .when((F.col(state) == "321") & in_set(events, walk_events), F.lit(1.0))
             .otherwise(x.cast("double")))


def leverage_credit(pa: DataFrame, game: str, at_bat: str, pitch: str, half: str,
                    inning: str, bat_score: str, fld_score: str,
                    post_home: str, post_away: str, bat_score_diff: str,
                    leverage: str, state: str, xr: str, events: str,
                    scope: str = "game", top: str = "Top",
                    walk_events: Sequence[str] = ("walk", "hit_by_pitch"),
                    margin: str = "batting", name: str = "LI_diff") -> DataFrame:
    """Leverage-weighted credit of each plate appearance (``LI_diff``).

    Run expectancy is clamped first.  The leverage that a PA ends, L less the
    next PA's (0 at the scope's last PA), is credited times (max_runs - xr)
    if the score held and charged times xr if not.  Before the scope's last PA
    the score held if the margin is the next PA's; where that is unknown, the
    last PA of a side in a close late game counts as held.  The last PA, in the
    9th or later, held if the fielding side won; the visitors are charged if
    the home side won.  Otherwise NULL.

    ``scope='game'`` evaluates next-PA and last-PA inside each game;
    ``scope='table'`` reproduces the ungrouped original, where the next PA
    of a game's last PA is the following game's first PA and "last" means
    the table-wide maximum at-bat number.

    "Score unchanged" compares the batting side's margin with the next
    PA's (``margin='batting'``, as the original; the sign flips when the
    half changes) or the home side's margin (``margin='home'``).
    """
    home = F.col(half) == top
    bat_margin = F.col(bat_score) - F.col(fld_score)
    if margin == "home":
        # the visitors bat in the top half
        m = F.when(home, -bat_margin).otherwise(bat_margin)
    elif margin == "batting":
        m = bat_margin
    else:
        raise ValueError("margin must be 'batting' or 'home'")
    x = pa.withColumns({
        "_home": home.cast("int"),
        "_mx": max_runs_possible(state).cast("double"),
        "_xr": clamp_run_expectancy(xr, state, events, walk_events),
        "_margin": m})
    order = [game, at_bat, pitch]
    if scope == "game":
        x = lead_in_group(x, [game], [at_bat, pitch], ["_margin", leverage], prefix="_n_",
                          group_aggs={
                              "_maxab": F.max(at_bat),
                              "_maxab_h": F.max(F.when(F.col("_home") == 1, F.col(at_bat))),
                              "_maxab_a": F.max(F.when(F.col("_home") == 0, F.col(at_bat)))})
    elif scope == "table":
        # the maxima need neither the lead nor the leverage: from the input, in one aggregate
        tot = scalar_aggs(x, {
            "_maxab": F.max(at_bat),
            "_maxab_h": F.max(F.when(F.col("_home") == 1, F.col(at_bat))),
            "_maxab_a": F.max(F.when(F.col("_home") == 0, F.col(at_bat)))})
        x = table_lead(x, game, [at_bat, pitch], ["_margin", leverage], prefix="_n_").withColumns(tot)
    else:
        raise ValueError("scope must be 'game' or 'table'")
    ends = F.col(at_bat) == F.col("_maxab")
    fields_home = F.col("_home") == 1
    home_won = F.when(F.col(post_home) != F.col(post_away), F.col(post_home) > F.col(post_away))
    # a side's last PA in the field: the 9th or later at home, the 8th away
    side_end = F.when(fields_home, F.col("_maxab_h")).otherwise(F.col("_maxab_a"))
    late = F.when(fields_home, F.col(inning) >= 9).otherwise(F.col(inning) == 8)
    closing = ((F.col(at_bat) == side_end) & (side_end < F.col("_maxab")) & late
               & (F.abs(F.col(bat_score_diff)) < 3))
    # True: the score held and the PA is credited; False: it is charged
    held = (F.when(~ends, F.coalesce(F.col("_margin") == F.col("_n__margin"), F.when(closing, True)))
             .when(ends & (F.col(inning) >= 9),
                   F.when(home_won == fields_home, True).when(home_won, False)))
    # visitors who win while the home side fields get nothing
    drop = F.col(leverage) - F.when(ends, F.lit(0.0)).otherwise(F.col(f"_n_{leverage}"))
    credit = (F.when(held, drop * (F.col("_mx") - F.col("_xr")))
               .when(~held, -F.abs(drop * F.col("_xr"))))
    out = x.withColumn(name, credit).withColumn("run_expectancy_clamped", F.col("_xr"))
    return out.drop("_home", "_mx", "_xr", "_margin", "_n__margin", f"_n_{leverage}",
                    "_maxab", "_maxab_h", "_maxab_a")


def table_lead(df: DataFrame, game: str, order_in_game: Sequence[str],
               cols: Sequence[str], prefix: str = "next_") -> DataFrame:
    """``lead`` over the whole table ordered by (game, order_in_game...).

    Inside a game the split-safe lead is used; a game's last row takes the
    first row of the next game, found with a lead over the one-row-per-game
    table (itself split-safe, so no single-partition window over the facts).
    """
    x = lead_in_group(df, [game], list(order_in_game), list(cols), prefix=prefix,
                      last_flag="_glast")
    firsts = df.groupBy(game).agg(F.min_by(F.struct(*[F.col(c) for c in cols]),
                                           F.struct(*[F.col(o) for o in order_in_game]))
                                  .alias("_first"))
    nxt = lead_in_group(firsts, [], [game], ["_first"], prefix="_ngf")
    nxt = nxt.select(game, F.col("_ngf_first").alias("_nf"))
    x = x.join(nxt, game, "left")
    x = x.withColumns({f"{prefix}{c}": F.when(F.col("_glast"), F.col(f"_nf.{c}"))
                       .otherwise(F.col(f"{prefix}{c}")) for c in cols})
    return x.drop("_glast", "_nf")


def season_leverage_total(df: DataFrame, entity: str, name_col: str, season: str,
                          credit: str = "LI_diff", min_n: int = 100,
                          tiebreak: str | None = None) -> DataFrame:
    """LPAA: credit centred on its table mean, then per (entity, name,
    season): plate appearances, total, total per PA; seasons with more than
    ``min_n`` PAs, ranked inside the season by total (ties by entity)."""
    x = center(df, [credit], suffix="_c")
    g = x.groupBy(entity, name_col, season).agg(
        F.count(F.lit(1)).alias("batters_faced"),
        zsum(f"{credit}_c").alias("new_saves"))
    g = g.withColumn("new_saves_bf", F.col("new_saves") / F.col("batters_faced"))
    g = g.where(F.col("batters_faced") > min_n)
    tb = tiebreak or entity
    g = g.withColumn("_neg", -F.col("new_saves"))
    return row_number_in_group(g, [season], ["_neg", tb], "rank").drop("_neg")


__all__ = [n for n in dir() if not n.startswith("_")]
