"""Appearance grain (game, pitcher, inning): start state, counts, outs,
zone shares, entry pitch count, and the joined appearance table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import count_if, in_set, strict_sum
from ..functions.zones import ZONES
from ..plans.ordered import lead_in_group, row_number_in_group
from ..session import materialize
from .verbs import join_keys_null_safe

# --- fixed values: event and batted-ball names counted per appearance
STRIKEOUT_EVENTS = ["strikeout", "strikeout_double_play"]
WALK_EVENTS = ["walk", "hit_by_pitch"]
HIT_EVENTS = ["single", "double", "triple", "home_run"]
BATTED_BALL_TYPES = {"GB": "ground_ball", "LD": "line_drive", "FB": "fly_ball",
                     "Pop": "popup"}
BALL_IN_PLAY = "hit_into_play"
BARREL_CLASS = 6


def appearance_start_state(pa: DataFrame, keys: Sequence[str], order: Sequence[str],
                           cols: dict[str, str]) -> DataFrame:
    """Values of the first plate appearance of each appearance (NULLs kept).

    ``cols`` maps output name -> input column.  ``min_by`` over the order
    struct is a partial aggregate (no window, no hot task).
    """
    first = F.min_by(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]),
                     F.struct(*[F.col(o) for o in order])).alias("_f")
    return pa.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{n}").alias(n)
                                                         for n in cols])


def outs_recorded(pitches: DataFrame, half_keys: Sequence[str], order: Sequence[str],
                  outs: str, keys: Sequence[str], name: str = "outs_made",
                  per_half: int = 3) -> DataFrame:
    """Outs recorded while each pitch was thrown, summed per appearance.

    Inside a half inning: next pitch's outs - this pitch's outs; the last
    pitch (or one followed by an unknown count) is credited
    ``per_half - outs``.  The sum is strict (NULL outs poison it).
    """
    x = lead_in_group(pitches, list(half_keys), list(order), [outs], prefix="_n_")
    x = x.withColumn("_made", F.coalesce(F.col(f"_n_{outs}"), F.lit(per_half)) - F.col(outs))
    return x.groupBy(*keys).agg(strict_sum("_made").alias(name))


def appearance_counts(pa: DataFrame, keys: Sequence[str], **kwargs) -> DataFrame:
    """Per appearance: batters faced, K, BB+HBP, barrels, mean exit velocity
    (0 when none), balls in play by type, hits, mean opponent rate and runs
    allowed = max(post-play batting score) - min(pre-play batting score)."""
    return pa.groupBy(*keys).agg(*appearance_count_exprs(**kwargs))


def appearance_count_exprs(events: str = "events",
                      launch_speed_angle: str | None = "launch_speed_angle",
                      launch_speed: str | None = "launch_speed",
                      description: str | None = "description",
                      bb_type: str | None = "bb_type",
                      bat_score: str = "bat_score", post_bat_score: str = "post_bat_score",
                      opp_rate: str | None = "wOBA",
                      strikeouts: Sequence[str] = STRIKEOUT_EVENTS,
                      walks: Sequence[str] = WALK_EVENTS,
                      hits: Sequence[str] = HIT_EVENTS,
                      bb_levels: dict[str, str] | None = None) -> list[Column]:
    """The aggregate expressions of ``appearance_counts``."""
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("batters_faced"),
        count_if(in_set(events, strikeouts)).alias("strikeouts"),
        count_if(in_set(events, walks)).alias("walks"),
        (F.max(post_bat_score) - F.min(bat_score)).alias("runs_allowed"),
        count_if(in_set(events, hits)).alias("H"),
    ]
    if launch_speed_angle:
        aggs.append(count_if(F.col(launch_speed_angle) == BARREL_CLASS).alias("barrels"))
    if launch_speed:
        aggs.append(F.coalesce(F.avg(launch_speed), F.lit(0.0)).alias("avg_exit_velocity"))
    if description:
        aggs.append(count_if(F.col(description) == BALL_IN_PLAY).alias("BIP"))
    if bb_type:
        for n, lv in (bb_levels or BATTED_BALL_TYPES).items():
            aggs.append(count_if(F.col(bb_type) == lv).alias(n))
    if opp_rate:
        aggs.append(F.avg(opp_rate).alias("mean_wOBA"))
    return aggs


def zone_share(pitches: DataFrame, keys: Sequence[str], zone: str,
               levels: Sequence[str] = ZONES, total: str = "num_pitches") -> DataFrame:
    """Share of pitches per zone level and the pitch total, one pass
    (a level never thrown is 0)."""
    n = F.count(F.lit(1))
    aggs = [n.alias(total)] + [(count_if(F.col(zone) == lv) / n).alias(lv) for lv in levels]
    return pitches.groupBy(*keys).agg(*aggs)


def pitch_rollup(pitches: DataFrame, keys: Sequence[str], half_keys: Sequence[str],
                 order: Sequence[str], outs: str | None, zone: str | None = None,
                 zone_levels: Sequence[str] = ZONES) -> DataFrame:
    """Every pitch-level roll-up of an appearance in one aggregate: outs
    recorded (needs one split-safe lead), pitch total, zone shares, and the
    first/last pitch (order structs) used for the entry pitch count."""
    x = pitches
    aggs: list[Column] = [F.count(F.lit(1)).alias("num_pitches"),
                          F.min(F.struct(*[F.col(o) for o in order])).alias("_first"),
                          F.max(F.struct(*[F.col(o) for o in order])).alias("_last")]
    if outs:
        x = lead_in_group(x, list(half_keys), list(order), [outs], prefix="_n_")
        made = F.coalesce(F.col(f"_n_{outs}"), F.lit(3)) - F.col(outs)
        aggs.append(strict_sum(made).alias("outs_made"))
    if zone:
        n = F.count(F.lit(1))
        aggs += [(count_if(F.col(zone) == lv) / n).alias(lv) for lv in zone_levels]
    return x.groupBy(*keys).agg(*aggs)


def entry_from_rollup(roll: DataFrame, game: str, pitcher: str,
                      name: str = "pitch_number_appearance") -> tuple[DataFrame, DataFrame]:
    """Entry pitch count from the per-appearance table: 1 + pitches of the
    same (game, pitcher) in earlier appearances.  Exact when a pitcher's
    appearances do not interleave in pitch order; the second frame holds
    the (game, pitcher) pairs where they do (empty in game data)."""
    from pyspark.sql import Window
    w = Window.partitionBy(game, pitcher).orderBy("_first")
    x = roll.withColumns({
        name: (F.coalesce(F.sum("num_pitches").over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long"),
        "_prev_last": F.lag("_last").over(w)})
    bad = x.where(F.col("_prev_last") > F.col("_first")).select(game, pitcher).distinct()
    return x.drop("_prev_last"), bad


def entry_pitch_count(pitches: DataFrame, game: str, pitcher: str, inning: str,
                      order: Sequence[str], name: str = "pitch_number_appearance",
                      exact: bool = False) -> DataFrame:
    """Running pitch count of (game, pitcher) at the first pitch of each
    inning it pitched (1 = first pitch of the outing).

    Default: counts per appearance (a partial aggregate) accumulated over
    the small per-appearance table - no shuffle of the pitches by pitcher.
    If some appearances interleave in pitch order, or with ``exact``, the
    running count comes from the split-safe row number instead.
    """
    keys = [game, pitcher, inning]
    if not exact:
        # a narrow partial aggregate: recomputing it for the check is cheaper
        # than writing it out
        roll = pitch_rollup(pitches.select(*keys, *order), keys, [], order, None)
        out, bad = entry_from_rollup(roll, game, pitcher, name)
        if bad.limit(1).count() == 0:
            return out.select(*keys, name)
    x = row_number_in_group(pitches.select(*keys, *order), [game, pitcher], list(order), "_rn")
    return x.groupBy(*keys).agg(F.min("_rn").cast("long").alias(name))


def pa_rollup(pa: DataFrame, keys: Sequence[str], order: Sequence[str],
              start_cols: dict[str, str], count_kwargs: dict | None = None) -> DataFrame:
    """Start state and all plate-appearance counts in one aggregate."""
    first = F.min_by(F.struct(*[F.col(c).alias(n) for n, c in start_cols.items()]),
                     F.struct(*[F.col(o) for o in order])).alias("_start")
    aggs = appearance_count_exprs(**(count_kwargs or {}))
    out = pa.groupBy(*keys).agg(first, *aggs)
    return out.select(*keys, *[F.col(f"_start.{n}").alias(n) for n in start_cols],
                      *[c for c in out.columns if c not in (*keys, "_start")])


def appearance_table(pitches: DataFrame, pa: DataFrame, spine: DataFrame,
                     game: str, pitcher: str, inning: str, half: str,
                     order: Sequence[str], outs: str,
                     start_cols: dict[str, str], zone: str | None,
                     zone_levels: Sequence[str] = ZONES,
                     count_kwargs: dict | None = None) -> DataFrame:
    """One row per appearance of the spine (e.g. relief appearances):
    start state, counts, outs, zone shares, entry pitch count.

    The plate-appearance roll-ups are one aggregate and the pitch roll-ups
    another (after one split-safe lead for the outs), and the entry pitch
    count comes from the pitch roll-up itself, so the appearance grain is
    reached with two aggregates and two joins instead of a chain of nine
    joins.
    """
    keys = [game, pitcher, inning]
    pa_level = pa_rollup(pa, keys, order, start_cols, count_kwargs)
    # one row per appearance, read twice (interleave check, final join):
    # written once to the shared folder
    roll = materialize(pitch_rollup(pitches, keys, [game, inning, half], order, outs,
                                    zone, zone_levels))
    pitch_level, bad = entry_from_rollup(roll, game, pitcher)
    if bad.limit(1).count() > 0:
        exact = entry_pitch_count(pitches, game, pitcher, inning, order, exact=True)
        pitch_level = pitch_level.drop("pitch_number_appearance").join(exact, keys, "left")
    pitch_level = pitch_level.drop("_first", "_last")
    allk = join_keys_null_safe(pa_level, pitch_level, keys, "left")
    out = join_keys_null_safe(spine.select(*keys).distinct(), allk, keys, "left")
    if "avg_exit_velocity" in out.columns:
        out = out.withColumn("avg_exit_velocity", F.coalesce("avg_exit_velocity", F.lit(0.0)))
    return out
