"""Plan-shape guards for every registered (non-model) query: no cartesian
product or nested-loop join, no window over a table in one task."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leverkit.plans import bindings
from leverkit.plans.shape import plan_faults

SF = "/root/testdata/sf0.001"
FITS = {name for name in bindings.QUERIES if name.startswith("gbt_")}


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - FITS))
def test_plan_shape(spark, name):
    assert plan_faults(bindings.QUERIES[name](spark, SF)) == []


def test_guard_sees_what_it_guards_against(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert plan_faults(df.withColumn("n", F.lead("id").over(Window.orderBy("id")))) == ["window in a single partition"]
    assert plan_faults(df.withColumn("n", F.sum("id").over(Window.partitionBy()))) == ["window in a single partition"]
    assert plan_faults(df.withColumn("n", F.lead("id").over(Window.partitionBy("g").orderBy("id")))) == []
    assert plan_faults(df.agg(F.sum("id"))) == []
    assert plan_faults(df.crossJoin(df.select(F.col("id").alias("k")))) != []


def test_bucketed_games_are_not_moved_again(spark):
    """Below the leads of a game, an aggregate by game and a join of two tables
    by game there is no exchange, and the results are those of plain tables."""
    from leverkit.operators import winexp
    from leverkit.sources import io
    rows = [(g, "Top" if a % 5 < 2 else "Bot", a, 0.5 + (g * a % 7) / 20, a % 4, a % 3, "out") for g in range(30) for a in range(20)]
    plain = spark.createDataFrame(rows, "game_pk long, inning_topbot string, at_bat_number int, we double, post_bat_score int, post_fld_score int, des string")
    pa = io.write_bucketed(plain, "pa_by_game", ["game_pk"], 4, ["at_bat_number"])
    last = io.write_bucketed(plain.groupBy("game_pk").agg(F.max("at_bat_number").alias("last")), "last_by_game", ["game_pk"], 4)
    delta = lambda x: winexp.delta_win_expectancy(x, "game_pk", "inning_topbot", "at_bat_number", "we", "post_bat_score", "post_fld_score", "des")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for x in (delta(pa), pa.groupBy("game_pk").count(), pa.join(last, "game_pk")):
            assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in delta(plain)._jdf.queryExecution().executedPlan().toString()
        assert delta(pa).exceptAll(delta(plain)).count() == 0 and delta(pa).count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE pa_by_game")
        spark.sql("DROP TABLE last_by_game")
