"""Game-state columns: base state, runners on, score context and flags.

All functions return Columns; inputs are column names so any table with
the same meaning can be used.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColOrName, col, flag

# --- fixed values: the eight base-state codes (3rd, 2nd, 1st; '_' = empty)
BASE_STATES = ["___", "__1", "_2_", "3__", "_21", "32_", "3_1", "321"]


def runner_on(state: ColOrName, base: int) -> Column:
    """Whether the code has a runner on ``base``; an unknown state has none."""
    return F.coalesce(F.substring(col(state), 4 - base, 1) == str(base), F.lit(False))


def base_state(on_1b: ColOrName, on_2b: ColOrName, on_3b: ColOrName) -> Column:
    """Three nullable runner columns -> one of the eight codes.

    Position i of the code is the runner on base 3-i, '_' when empty.
    A non-NULL runner id means the base is occupied.
    """
    return F.concat(
        F.when(col(on_3b).isNotNull(), F.lit("3")).otherwise(F.lit("_")),
        F.when(col(on_2b).isNotNull(), F.lit("2")).otherwise(F.lit("_")),
        F.when(col(on_1b).isNotNull(), F.lit("1")).otherwise(F.lit("_")),
    )


def runners_on(state: ColOrName) -> Column:
    """Number of occupied bases of a state code."""
    s = col(state)
    return F.length(F.translate(s, "_", "")).cast("int")


def max_runs_possible(state: ColOrName) -> Column:
    """Most runs one plate appearance can score: batter + runners on."""
    return runners_on(state) + F.lit(1)


def max_possible_runs(state: ColOrName, batters_faced: ColOrName) -> Column:
    """Appearance level: runners on at entry + batters faced."""
    return runners_on(state) + col(batters_faced)


def is_home_pitcher(half: ColOrName, top_value: str = "Top") -> Column:
    """The home side pitches the top half: 1 for 'Top', else 0 (NULL stays NULL)."""
    return flag(col(half) == F.lit(top_value))


def score_context(bat_score: ColOrName, fld_score: ColOrName,
                  inning: ColOrName, inning_cap: int = 10) -> dict[str, Column]:
    """Score difference from the fielding side, its size, total, capped inning."""
    diff = col(fld_score) - col(bat_score)
    return {
        "pitcher_score_diff": diff,
        "abs_score_diff": F.abs(diff),
        "total_runs_scored": col(bat_score) + col(fld_score),
        "inning_capped": F.when(col(inning) > inning_cap - 1, F.lit(inning_cap))
                          .otherwise(col(inning)),
    }


def tying_run_flag(score_diff: ColOrName, state: ColOrName) -> Column:
    """1 when the tying or winning run is at bat or on base.

    The fielding side's lead must be between 0 and what one plate appearance
    can score.  An unknown state or lead counts as not tying.
    """
    return F.coalesce(col(score_diff).between(0, max_runs_possible(state)), F.lit(False)).cast("int")


def walkoff_flag(half: ColOrName, inning: ColOrName, tying: ColOrName,
                 bottom_value: str = "Bot", from_inning: int = 9) -> Column:
    """Bottom half, inning >= 9 and the tying run is up (three-valued)."""
    return flag((col(half) == bottom_value) & (col(inning) >= from_inning)
                & (col(tying) == 1))


def gidp_flag(state: ColOrName, outs: ColOrName) -> Column:
    """Double play possible: runner on first and fewer than two outs."""
    return flag(runner_on(state, 1) & (col(outs) < 2))


def sac_fly_flag(state: ColOrName, outs: ColOrName) -> Column:
    """Sacrifice fly possible: runner on third and fewer than two outs."""
    return flag(runner_on(state, 3) & (col(outs) < 2))
