import os
import tempfile

from pyspark.sql import types as T

from leverkit.streaming import ingest_landed_files

SCHEMA = T.StructType([T.StructField("game_pk", T.LongType()),
                       T.StructField("game_date", T.DateType()),
                       T.StructField("pitcher", T.LongType())])


def test_incremental_ingest_is_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="lk-stream-")
    src = os.path.join(root, "landing")
    os.makedirs(src)
    with open(os.path.join(src, "d1.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n1,2024-04-01,7\nbad,2024-04-01,7\n")
    good, bad, ck = (os.path.join(root, n) for n in ("good", "bad", "ck"))
    c1 = ingest_landed_files(spark, src, SCHEMA, good, bad, checkpoint=ck)
    assert c1 == {"good": 1, "bad": 1}
    c2 = ingest_landed_files(spark, src, SCHEMA, good, bad, checkpoint=ck)
    assert c2 == {"good": 0, "bad": 0}
    with open(os.path.join(src, "d2.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n2,2024-04-02,NA\n")
    c3 = ingest_landed_files(spark, src, SCHEMA, good, bad, checkpoint=ck)
    assert c3 == {"good": 1, "bad": 0}
    assert sorted(r.game_pk for r in spark.read.parquet(good).collect()) == [1, 2]


def test_a_failed_batch_leaves_no_duplicate(spark, monkeypatch):
    import pytest
    from pyspark.sql import DataFrameWriter

    root = tempfile.mkdtemp(prefix="lk-stream-")
    src = os.path.join(root, "landing")
    os.makedirs(src)
    with open(os.path.join(src, "d1.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n1,2024-04-01,7\n2,2024-04-01,7\nbad,2024-04-01,7\n")
    good, bad, ck = (os.path.join(root, n) for n in ("good", "bad", "ck"))
    write = DataFrameWriter.parquet

    def fails(self, path, *a, **k):
        if path.startswith(bad):
            raise OSError("no space")
        return write(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", fails)
        with pytest.raises(Exception):
            ingest_landed_files(spark, src, SCHEMA, good, bad, checkpoint=ck)
    assert ingest_landed_files(spark, src, SCHEMA, good, bad, checkpoint=ck) == {"good": 2, "bad": 1}
    assert sorted(r.game_pk for r in spark.read.parquet(good).collect()) == [1, 2]
    assert spark.read.parquet(bad).count() == 1
