from leverkit.session import materialize, scale_conf, shared_dir


def test_scale_conf_sizes_partitions():
    big = scale_conf(100 * 2 ** 40, total_cores=8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    small = scale_conf(10 * 2 ** 20, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(128 * 2 ** 20)


def test_shared_dir_and_materialize(spark):
    d = shared_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    df = spark.range(10).selectExpr("id", "id * 2 AS x")
    m = materialize(df)
    assert sorted(r.x for r in m.collect()) == [2 * i for i in range(10)]
    # the written copy has no lineage back to the range
    assert "Range" not in m._jdf.queryExecution().optimizedPlan().toString()
