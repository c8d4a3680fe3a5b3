"""Fixtures F-state, F-zone and F-null."""
import itertools
import math

import pytest
from pyspark.sql import functions as F

from leverkit.functions import nulls, state as st
from leverkit.functions.zones import attack_zone


def test_base_state_all_combinations(spark):
    rows = [tuple(1 if b else None for b in combo) for combo in
            itertools.product([False, True], repeat=3)]
    df = spark.createDataFrame(rows, "on_1b int, on_2b int, on_3b int")
    out = df.select("on_1b", "on_2b", "on_3b",
                    st.base_state("on_1b", "on_2b", "on_3b").alias("s")) \
            .withColumn("mx", st.max_runs_possible("s")).collect()
    got = {(r.on_1b is not None, r.on_2b is not None, r.on_3b is not None): (r.s, r.mx)
           for r in out}
    assert got[(False, False, False)] == ("___", 1)
    assert got[(True, False, False)] == ("__1", 2)
    assert got[(False, True, False)] == ("_2_", 2)
    assert got[(False, False, True)] == ("3__", 2)
    assert got[(True, True, False)] == ("_21", 3)
    assert got[(False, True, True)] == ("32_", 3)
    assert got[(True, False, True)] == ("3_1", 3)
    assert got[(True, True, True)] == ("321", 4)
    assert sorted(s for s, _ in got.values()) == sorted(st.BASE_STATES)


def test_tying_run_limits(spark):
    # tying-run limit is runners on + 1, and a lead over 4 never counts
    rows = [(s, d) for s in st.BASE_STATES for d in range(-1, 7)]
    df = spark.createDataFrame(rows, "s string, d int")
    out = df.select("s", "d", st.tying_run_flag("d", "s").alias("t")).collect()
    limits = {"___": 1, "__1": 2, "_2_": 2, "3__": 2, "_21": 3, "32_": 3, "3_1": 3, "321": 4}
    for r in out:
        exp = 1 if (0 <= r.d <= limits[r.s] and r.d <= 4) else 0
        assert r.t == exp, r


def test_flags_keep_unknowns(spark):
    df = spark.createDataFrame([("Bot", 9, 1), ("Top", 9, 1), (None, 9, 1), ("Bot", 8, 1)],
                               "h string, inn int, t int")
    got = [r.w for r in df.select(st.walkoff_flag("h", "inn", "t").alias("w")).collect()]
    assert got == [1, 0, None, 0]
    df2 = spark.createDataFrame([("__1", 1), ("__1", None), ("___", None), ("3_1", 2)],
                                "s string, o int")
    got2 = df2.select(st.gidp_flag("s", "o").alias("g"), st.sac_fly_flag("s", "o").alias("f")).collect()
    assert [(r.g, r.f) for r in got2] == [(1, 0), (None, 0), (0, 0), (0, 0)]


ZONE_ROWS = [
    (0.0, 2.5, "Heart"), (0.6, 2.5, "Shadow"), (1.2, 2.5, "Chase"), (2.0, 2.5, "Waste"),
    (0.0, 3.5, "Shadow"), (0.0, 1.5, "Shadow"), (0.0, 4.0, "Chase"), (0.0, 4.6, "Waste"),
    (0.0, 0.4, "Waste"), (None, 2.5, "Chase"), (2.0, None, "Waste"),
]


def test_attack_zone_fixture(spark):
    df = spark.createDataFrame([(x, z, 3.5, 1.5, e) for x, z, e in ZONE_ROWS],
                               "x double, z double, top double, bot double, e string")
    out = df.select("e", attack_zone("x", "z", "top", "bot").alias("z")).collect()
    assert [r.z for r in out] == [r.e for r in out]


def test_attack_zone_zero_height_band(spark):
    # top == bottom: above the band is +inf % (Waste), at the band NaN (Chase)
    df = spark.createDataFrame([(0.0, 2.0), (0.0, 1.5), (0.0, 1.0)], "x double, z double")
    out = df.select(attack_zone("x", "z", F.lit(1.5), F.lit(1.5)).alias("z")).collect()
    assert [r.z for r in out] == ["Waste", "Chase", "Waste"]


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, 500.0), (1, 2.0, None), (2, None, None)],
                               "g int, x double, d double")
    out = {r.g: r for r in df.groupBy("g").agg(
        nulls.zsum("x").alias("z"), nulls.strict_sum("x").alias("s"),
        nulls.count_if(F.col("d") >= 400).alias("c")).collect()}
    assert out[1].z == 2.0 and out[1].s is None and out[1].c == 1
    assert out[2].z == 0 and out[2].s is None and out[2].c == 0
    f = df.select(nulls.flag(F.col("d") >= 400).alias("f")).collect()
    assert [r.f for r in f] == [1, None, None]
    m = df.select(nulls.in_set("x", [2.0]).alias("m")).collect()
    assert [r.m for r in m] == [False, True, False]
    fin = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert [r.f for r in fin.select(nulls.finite("v").alias("f")).collect()] == \
        [True, False, False, False]
    assert math.isclose(spark.range(1).select(nulls.safe_div(F.lit(1), F.lit(4)).alias("r"))
                        .first().r, 0.25)
    assert spark.range(1).select(nulls.safe_div(F.lit(1), F.lit(0)).alias("r")).first().r is None


if __name__ == "__main__":  # pragma: no cover
    pytest.main([__file__])
