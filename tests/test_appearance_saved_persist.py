"""Fixtures F-outs, F-quantile, F-ols; appearance and season invariants."""
import math

import pytest
from pyspark.sql import functions as F

from leverkit.operators import appearance as app
from leverkit.operators import persist, saved


@pytest.mark.parametrize("split", [False, True])
def test_outs_fixture(spark, split, request):
    if split:
        request.getfixturevalue("small_groups")
    rows = [(1, 1, "Top", 9, 1, 1, 0), (1, 1, "Top", 9, 1, 2, 0), (1, 1, "Top", 9, 2, 1, 1),
            (1, 1, "Top", 8, 3, 1, 1), (1, 1, "Top", 8, 4, 1, 2)]
    df = spark.createDataFrame(rows, "g long, inn int, h string, pit long, ab int, p int, o int")
    out = app.outs_recorded(df, ["g", "inn", "h"], ["ab", "p"], "o", ["g", "pit", "inn"])
    assert {r.pit: r.outs_made for r in out.collect()} == {9: 1, 8: 2}


def test_entry_pitch_count_and_start_state(spark):
    rows = [(1, 9, 7, 1, 1, 0, None), (1, 9, 7, 1, 2, 0, None), (1, 9, 7, 2, 1, 1, 5),
            (1, 9, 8, 3, 1, 0, None), (1, 9, 8, 3, 2, 0, 4), (1, 4, 8, 4, 1, 2, 6)]
    df = spark.createDataFrame(rows, "g long, pit long, inn int, ab int, p int, o int, r1 long")
    e = {(r.pit, r.inn): r.pitch_number_appearance
         for r in app.entry_pitch_count(df, "g", "pit", "inn", ["ab", "p"]).collect()}
    assert e == {(9, 7): 1, (9, 8): 4, (4, 8): 1}
    s = {(r.pit, r.inn): (r.outs_start, r.base_1b) for r in app.appearance_start_state(
        df, ["g", "pit", "inn"], ["ab", "p"], {"outs_start": "o", "base_1b": "r1"}).collect()}
    assert s[(9, 7)] == (0, None) and s[(9, 8)] == (0, None) and s[(4, 8)] == (2, 6)


def test_entry_pitch_count_interleaved_falls_back_to_exact(spark):
    rows = [(1, 9, 1, 1, 1), (1, 9, 2, 2, 1), (1, 9, 1, 3, 1), (1, 9, 3, 4, 1)]
    df = spark.createDataFrame(rows, "g long, pit long, inn int, ab int, p int")
    e = {r.inn: r.pitch_number_appearance
         for r in app.entry_pitch_count(df, "g", "pit", "inn", ["ab", "p"]).collect()}
    assert e == {1: 1, 2: 2, 3: 4}


def test_zone_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, "Heart"), (1, "Heart"), (1, "Waste"), (2, "Chase")],
                               "k int, z string")
    out = app.zone_share(df, ["k"], "z").collect()
    for r in out:
        assert math.isclose(r.Heart + r.Shadow + r.Chase + r.Waste, 1.0)
    assert {r.k: r.num_pitches for r in out} == {1: 3, 2: 1}


@pytest.mark.parametrize("split", [False, True])
def test_quantile_trim_fixture(spark, split, request):
    if split:
        request.getfixturevalue("small_groups")
    rows = [(1, float(v)) for v in (1, 2, 3, 4, 10)] + [(1, None), (2, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    kept = saved.trim_open_quantiles(df, ["g"], "v").collect()
    assert sorted(r.v for r in kept) == [2.0, 3.0, 4.0]
    from leverkit.plans.ordered import exact_quantiles
    q = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": .05, "hi": .95}).collect()}
    assert math.isclose(q[1].lo, 1.2) and math.isclose(q[1].hi, 8.8)
    assert q[2].lo == 5.0


def test_season_runs_saved_rules(spark):
    rows = [(1, 10, 2024, 1.0, 0.5, 3), (1, 10, 2024, 0.5, 0.5, 3), (1, 11, 2024, -1.0, 0.0, 0),
            (2, 20, 2024, 1.0, None, 3), (2, 21, 2024, 1.0, 1.0, 3),
            (3, 30, 2024, 1.0, 1.0, 0), (3, 31, 2024, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "p int, g int, y int, actual_rapo double, "
                                     "expected_rapo double, outs int")
    out = {r.p: r for r in saved.season_runs_saved(df, "p", "g", "y", "outs",
                                                   min_appearances=1).collect()}
    assert out[1].appearances == 2 and math.isclose(out[1].actual_rapo_season, 0.5 / 6 * 3)
    assert 2 not in out  # strict sum: one NULL expected value drops the season
    assert 3 not in out  # no outs: non-finite rate dropped


def test_ols_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (4.0, 4.0), (None, 9.0)],
                               "x double, y double")
    s = persist.stickiness(df, "x", "y").first()
    assert s.n == 4 and math.isclose(s.slope, 0.8) and math.isclose(s.intercept, 1.5)
    assert math.isclose(s.r, 0.8) and math.isclose(s.r2, 0.64)
    assert math.isclose(persist.ols_summary(df, "x", "y").first().p_slope, 0.2, abs_tol=1e-9)


def test_prior_season_and_override(spark):
    df = spark.createDataFrame([(1, 2021, 1.0, 5), (1, 2023, 2.0, 6), (2, 2022, 3.0, 7)],
                               "p int, y int, v double, n int")
    out = persist.prior_season_lag(df, "p", "y", ["v"])
    out = persist.point_override(out, {"p": 1, "y": 2023}, "n", 401)
    got = {(r.p, r.y): (r.prev_v, r.n) for r in out.collect()}
    assert got == {(1, 2021): (None, 5), (1, 2023): (1.0, 401), (2, 2022): (None, 7)}
    c = persist.prior_season_lag(df, "p", "y", ["v"], consecutive_only=True)
    assert {(r.p, r.y): r.prev_v for r in c.collect()}[(1, 2023)] is None


def test_histogram(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 3.99), ("a", 4.0), ("a", None)],
                               "f string, v double")
    got = {r.bucket: r.n for r in persist.histogram(df, ["f"], "v", 0.0, 4.0, 8).collect()}
    assert got == {0: 1, 1: 1, 8: 1, 9: 1}


if __name__ == "__main__":  # pragma: no cover
    pytest.main([__file__])


def test_trimmed_with_centering_and_game_grouping(spark):
    # the unused branch of the source: centre on table means, trim per game
    rows = [(1, g, 2024, float(v), 0.0, 3) for g, v in [(1, 1), (1, 2), (1, 3), (2, 10)]]
    df = spark.createDataFrame(rows, "p int, g int, y int, actual_rapo double, "
                                     "expected_rapo double, outs int")
    out = saved.trimmed_season_runs_saved(df, "p", "g", "y", "outs", by=["p", "g", "y"],
                                          center=True, min_appearances=0).collect()
    # only the middle value of game 1 survives: (2 - 4) centred, over 3 outs
    assert len(out) == 1 and out[0].appearances == 1 and out[0].outs_made == 3
    assert math.isclose(out[0].actual_rapo_season, (2 - 4) / 3 * 3)
