"""Fixtures F-delta and F-credit; leverage invariants; labels."""
import math

import pytest

from leverkit.functions import state as st
from leverkit.operators import winexp

F_DELTA = [  # game, at_bat, half, WE, post_bat, post_fld, expected
    (1, 1, "Top", .50, 0, 0, .02), (1, 2, "Top", .52, 0, 0, .18),
    (1, 3, "Bot", .45, 1, 0, -.05), (1, 4, "Bot", .40, 1, 0, -.10),
    (1, 5, "Top", .70, 0, 1, .00), (1, 6, "Bot", .30, 2, 0, -.30),
    (2, 1, "Top", .50, 0, 0, -.05), (2, 2, "Bot", .55, 0, 1, .45),
]


def _delta_df(spark):
    return spark.createDataFrame(
        [r[:6] + ("x",) for r in F_DELTA],
        "g long, ab long, half string, we double, pb int, pf int, des string")


@pytest.mark.parametrize("split", [False, True])
def test_delta_fixture(spark, split, request):
    if split:
        request.getfixturevalue("small_groups")
    out = winexp.delta_win_expectancy(_delta_df(spark), "g", "half", "ab", "we", "pb", "pf", "des")
    got = {(r.g, r.ab): r.new_delta_win_exp for r in out.collect()}
    for g, ab, *_, exp in F_DELTA:
        assert math.isclose(got[(g, ab)], exp, abs_tol=1e-9), (g, ab, got[(g, ab)])


def test_delta_balk_on_last_pa(spark):
    df = spark.createDataFrame([(1, 1, "Top", .5, 1, 1, "x"), (1, 2, "Bot", .6, 1, 1, "a balk")],
                               "g long, ab long, half string, we double, pb int, pf int, des string")
    out = {r.ab: r.new_delta_win_exp
           for r in winexp.delta_win_expectancy(df, "g", "half", "ab", "we", "pb", "pf", "des").collect()}
    assert math.isclose(out[2], -0.6) and math.isclose(out[1], (1 - .6) - .5)


# game, at_bat, half, inning, bat, fld, post_home, post_away, L, runners, xr, game, table
F_CREDIT = [
    (1, 70, "Top", 8, 2, 3, 3, 2, 1.0, 0, .2, -.32, -.32),
    (1, 71, "Top", 8, 2, 3, 3, 3, 1.4, 1, .5, -.30, -.30),
    (1, 72, "Top", 9, 3, 3, 3, 3, 2.0, 1, .4, -.20, -.20),
    (1, 75, "Top", 9, 3, 4, 4, 3, 1.5, 0, .1, 1.35, .27),
    (2, 80, "Bot", 9, 1, 2, 1, 2, 1.2, 0, .1, -.54, -.54),
    (2, 82, "Bot", 9, 1, 2, 3, 2, 1.8, 2, .6, -1.08, -1.08),
]


def _credit_df(spark):
    rows = []
    for g, ab, h, inn, b, f, ph, pa, L, ro, xr, *_ in F_CREDIT:
        on = [1 if i < ro else None for i in range(3)]
        rows.append((g, ab, 1, h, inn, b, f, ph, pa, b - f, L, on[0], on[1], on[2], xr, "x"))
    df = spark.createDataFrame(rows, "g long, ab long, p int, half string, inning int, bat int, "
                               "fld int, ph int, pa int, bsd int, L double, o1 int, o2 int, "
                               "o3 int, xr double, ev string")
    return df.withColumn("s", st.base_state("o1", "o2", "o3"))


@pytest.mark.parametrize("scope,idx", [("game", 11), ("table", 12)])
@pytest.mark.parametrize("split", [False, True])
def test_credit_fixture(spark, scope, idx, split, request):
    if split:
        request.getfixturevalue("small_groups")
    out = winexp.leverage_credit(_credit_df(spark), "g", "ab", "p", "half", "inning", "bat", "fld",
                                 "ph", "pa", "bsd", "L", "s", "xr", "ev", scope=scope)
    got = {r.ab: r.LI_diff for r in out.collect()}
    for row in F_CREDIT:
        assert math.isclose(got[row[1]], row[idx], abs_tol=1e-9), (scope, row[1], got[row[1]])


def test_credit_clamp(spark):
    df = spark.createDataFrame([(-1.0, "___", "x"), (5.0, "___", "x"), (2.0, "321", "walk"),
                                (None, "___", "x")], "xr double, s string, ev string")
    got = [r.c for r in df.select(winexp.clamp_run_expectancy("xr", "s", "ev").alias("c")).collect()]
    assert got == [0.0, 4.0, 1.0, None]


def test_leverage_mean_is_one(spark):
    df = spark.createDataFrame([(1, 0.1), (2, -0.3), (3, 0.05), (4, None)], "k int, sw double")
    out = winexp.leverage_index(df, "sw")
    m = out.selectExpr("avg(leverage) AS m").first().m
    assert math.isclose(m, 1.0)


def test_winner_label_and_starter(spark):
    rows = [(1, 1, 1, "Top", 10, 0, 0), (1, 2, 1, "Bot", 11, 1, 0), (1, 3, 1, "Top", 12, 2, 3),
            (2, 1, 1, "Top", 20, 5, 1), (2, 2, 1, None, 21, 5, 5)]
    df = spark.createDataFrame(rows, "g long, ab long, p int, half string, pit long, hs int, aw int")
    x = winexp.game_winner_label(df, "g", ["ab", "p"], "hs", "aw")
    x = x.withColumn("pw", winexp.side_win_label("home_win", "half"))
    x = winexp.starter_id(x, ["g", "half"], ["ab", "p"], "pit")
    got = {(r.g, r.ab): (r.home_win, r.pw, r.sp) for r in x.collect()}
    assert got[(1, 1)] == (0, 0, 10) and got[(1, 2)] == (0, 1, 11) and got[(1, 3)] == (0, 0, 10)
    # game 2 ends tied -> home_win 0; NULL half -> unknown label, own starter
    assert got[(2, 1)] == (0, 0, 20) and got[(2, 2)] == (0, None, 21)


def test_season_leverage_total_rank(spark):
    rows = [(p, "n", 2024, v) for p, v in [(1, 1.0), (1, 1.0), (2, 3.0), (2, None), (3, -1.0),
                                           (3, -1.0)]]
    df = spark.createDataFrame(rows, "p long, nm string, y int, c double")
    out = {r.p: r for r in winexp.season_leverage_total(df, "p", "nm", "y", "c", min_n=1).collect()}
    # mean of non-null credit = 0.6
    assert math.isclose(out[2].new_saves, 2.4) and out[2].rank == 1
    assert math.isclose(out[1].new_saves, 0.8) and out[1].rank == 2
    assert out[3].rank == 3 and out[2].batters_faced == 2


if __name__ == "__main__":  # pragma: no cover
    pytest.main([__file__])


def test_game_context_equals_separate_operators(spark):
    rows = [(1, 1, 1, "Top", 10, 0, 0), (1, 2, 1, "Bot", 11, 1, 0), (1, 3, 1, "Top", 12, 2, 3),
            (2, 1, 1, "Top", 20, 5, 1), (2, 2, 1, None, 21, 5, 5), (2, 3, 1, None, 22, 5, 6)]
    df = spark.createDataFrame(rows, "g long, ab long, p int, half string, pit long, hs int, aw int")
    a = winexp.attach_game_context(df, "g", "half", ["ab", "p"], "pit", "hs", "aw")
    b = winexp.starter_id(winexp.game_winner_label(df, "g", ["ab", "p"], "hs", "aw"),
                          ["g", "half"], ["ab", "p"], "pit")
    key = lambda r: (r.g, r.ab)
    assert sorted(((r.g, r.ab, r.home_win, r.sp) for r in a.collect()), key=lambda t: t[:2]) == \
        sorted(((r.g, r.ab, r.home_win, r.sp) for r in b.collect()), key=lambda t: t[:2])
    _ = key


def test_credit_home_margin_option(spark):
    # a scoreless change of half: batting margin 0 -> 0 stays "unchanged"
    # either way; a 1-0 lead flips sign for the batting margin only
    rows = [(1, 1, 1, "Top", 9, 0, 1, 0, 0, 0, 1.0, None, None, None, 0.2, "x"),
            (1, 2, 1, "Bot", 9, 1, 0, 0, 0, 0, 2.0, None, None, None, 0.2, "x"),
            (1, 3, 1, "Bot", 9, 1, 0, 1, 0, 0, 3.0, None, None, None, 0.2, "x")]
    df = spark.createDataFrame(rows, "g long, ab long, p int, half string, inning int, bat int, "
                               "fld int, ph int, pa int, bsd int, L double, o1 int, o2 int, "
                               "o3 int, xr double, ev string") \
              .withColumn("s", st.base_state("o1", "o2", "o3"))
    args = ("g", "ab", "p", "half", "inning", "bat", "fld", "ph", "pa", "bsd", "L", "s", "xr", "ev")
    bat = {r.ab: r.LI_diff for r in winexp.leverage_credit(df, *args).collect()}
    home = {r.ab: r.LI_diff for r in winexp.leverage_credit(df, *args, margin="home").collect()}
    # PA 1: batting margin -1 (visitors trail) vs next +1 -> changed
    assert math.isclose(bat[1], -abs((1.0 - 2.0) * 0.2))
    # home margin +1 then +1 -> unchanged
    assert math.isclose(home[1], (1.0 - 2.0) * (1 - 0.2))
