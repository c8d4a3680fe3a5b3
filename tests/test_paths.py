"""The three end-to-end analyses on a generated play-by-play table."""
import math

import pytest
from pyspark.sql import functions as F

from leverkit.plans import paths
from leverkit.operators import winexp

from .game_data import SCHEMA, make_pitches


FEW = dict(max_rounds=5, patience=2, parallelism=2)


@pytest.fixture(scope="module")
def game(spark):
    pitches = spark.createDataFrame(make_pitches(), SCHEMA).cache()
    pa = winexp.to_plate_appearance(pitches, "game_pk", "at_bat_number", "pitch_number")
    relief = pa.where(~F.col("pitcher").isin(100, 200))
    names = pitches.select("pitcher").distinct().withColumn(
        "player_name", F.concat(F.lit("P"), F.col("pitcher").cast("string")))
    return pitches, pa, relief, names


def test_outs_per_half_inning_is_three(spark, game):
    from leverkit.operators import appearance as app
    pitches, *_ = game
    o = app.outs_recorded(pitches, ["game_pk", "inning", "inning_topbot"], paths.GAME_ORDER,
                          "outs_when_up", ["game_pk", "inning", "inning_topbot"])
    assert {r.outs_made for r in o.collect()} == {3}


def test_leverage_path(spark, game):
    pitches, pa, relief, names = game
    out = paths.leverage_path(pitches, relief, names=names, min_pa=1, pa_table="pa_of_the_path", buckets=4, **FEW)
    # the mean is taken over the credited (relief) appearances
    lev = out["credit"].agg(F.avg("leverage")).first()[0]
    assert math.isclose(lev, 1.0, rel_tol=1e-9)
    assert out["swing"].where("new_delta_win_exp is null").count() == 0
    assert out["models"]["win"].context == out["models"]["swing"].context != {}
    we = out["win_exp"].agg(F.min("updated_pitcher_win_exp"), F.max("updated_pitcher_win_exp")).first()
    assert 0 <= we[0] <= we[1] <= 1
    assert out["credit"].count() == relief.count()
    lp = out["season_lpaa"].collect()
    assert lp and all(r.rank >= 1 for r in lp)
    years = {r.game_year for r in lp}
    for y in years:
        ranks = sorted(r.rank for r in lp if r.game_year == y)
        assert ranks == list(range(1, len(ranks) + 1))


def test_runs_saved_and_rest_paths(spark, game):
    pitches, pa, relief, names = game
    woba = winexp.batter_season_rate(pitches, "batter", "game_year", "events",
                                     "woba_value", "woba_denom")
    b = paths.runs_saved_path(pitches, relief, woba, names=names, min_games=0, **FEW)
    apps = b["appearances"]
    assert apps.count() == relief.select("game_pk", "pitcher", "inning").distinct().count()
    shares = apps.select((F.col("Heart") + F.col("Shadow") + F.col("Chase") + F.col("Waste"))
                         .alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in shares)
    assert b["season"].count() > 0
    # a relief appearance that no pitch matches takes its season's sums down with it, unless it is left out
    lost = relief.limit(1).withColumns({"game_pk": relief.limit(1).select("game_pk").scalar(), "inning": F.lit(77)})
    c = paths.runs_saved_path(pitches, relief.unionByName(lost), woba, names=names, min_games=0, **FEW)
    rows = lambda x: {(r.pitcher, r.game_year, r.appearances) for r in x["season"].collect()}
    assert rows(c) == rows(b) and c["appearances"].where("inning = 77").count() == 0
    aaa = spark.createDataFrame(
        [(900 + i, pitches.first().game_date, 101 + i % 3) for i in range(3)],
        "game_pk long, game_date date, `matchup.pitcher.id` long")
    c = paths.rest_path(pa, aaa, apps, b["season_trimmed"], names=names)
    prof = c["rest_profile"].collect()
    assert prof and all(0 <= r.entropy <= math.log(12) + 1e-12 for r in prof)
    assert c["rest_days"].where("days_of_rest < -1").count() == 0
    import tempfile
    out = tempfile.mkdtemp(prefix="lk-paths-")
    written = paths.write_outputs({"season": b["season"], "rest": {"profile": c["rest_profile"]}},
                                  out)
    assert len(written) == 2
    back = spark.read.parquet(written[0])
    assert back.count() == b["season"].count() and "game_year" in back.columns
