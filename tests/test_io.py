"""Sources and sinks: tolerant ingest, multi-file scan, spine, round trips."""
import datetime as dt
import os
import tempfile

from pyspark.sql import types as T

from leverkit.sources import io

SCHEMA = T.StructType([T.StructField("game_pk", T.LongType()),
                       T.StructField("game_date", T.DateType()),
                       T.StructField("pitcher", T.LongType())])


def test_tolerant_read_splits_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="lk-io-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n1,2024-04-01,7\nx,2024-04-02,7\n2,2024-04-03,8\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n3,not-a-date,9\n4,2024-04-05,NA\n")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write("game_pk,game_date,pitcher\n")
    good, bad, skipped, broken, _ = io.tolerant_read(spark, os.path.join(d, "*.csv"), SCHEMA)
    assert broken == {}
    assert [os.path.basename(x) for x in skipped] == ["c.csv"]
    assert sorted(r.game_pk for r in good.collect()) == [1, 2, 4]
    assert bad.count() == 2


def test_csv_multi_file_union_and_na(spark):
    d = tempfile.mkdtemp(prefix="lk-io-")
    for i in range(3):
        with open(os.path.join(d, f"y{i}.csv"), "w") as f:
            f.write(f"game_pk,game_date,pitcher\n{i},2024-0{i + 1}-01,NA\n")
    df = io.read_csv(spark, [os.path.join(d, f"y{i}.csv") for i in range(3)], SCHEMA)
    rows = sorted(df.collect())
    assert [r.game_pk for r in rows] == [0, 1, 2] and all(r.pitcher is None for r in rows)


def test_parquet_round_trip_partitioned(spark):
    d = tempfile.mkdtemp(prefix="lk-io-")
    df = spark.createDataFrame([(1, 2023), (2, 2024)], "k int, game_year int")
    io.write_parquet(df, os.path.join(d, "t"), partition_by=["game_year"])
    back = io.read_parquet(spark, os.path.join(d, "t"), required=["k"])
    assert sorted((r.k, r.game_year) for r in back.collect()) == [(1, 2023), (2, 2024)]


def test_date_spine(spark):
    s = io.date_spine(spark, "2024-02-27", "2024-03-01").collect()
    assert [r.day for r in s] == [dt.date(2024, 2, 27), dt.date(2024, 2, 28),
                                  dt.date(2024, 2, 29), dt.date(2024, 3, 1)]


def test_csv_sink_round_trip_and_row_bind(spark):
    d = tempfile.mkdtemp(prefix="lk-io-")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), 7)], SCHEMA)
    io.write_csv(df, os.path.join(d, "out"))
    back = io.read_csv(spark, os.path.join(d, "out"), SCHEMA)
    assert back.collect() == df.collect()
    other = spark.createDataFrame([(2, 9)], "game_pk long, extra long")
    both = io.read_many(spark, ["a", "b"], lambda s, p: df if p == "a" else other)
    rows = sorted(both.collect(), key=lambda r: r.game_pk)
    assert rows[0].extra is None and rows[1].pitcher is None


def write(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_many_files_by_header(spark):
    """1,000 files with three headers: three scans, all rows, names bound."""
    d = tempfile.mkdtemp(prefix="lk-io-")
    heads = ["k,a,b", "b,k", 'k,"c, quoted"']
    for i in range(1000):
        h = heads[i % 3]
        write(d, f"f{i:04}.csv", h + "\n" + {0: f"{i},x,NA", 1: f" y ,{i}", 2: f'{i},"z, {i}"'}[i % 3] + "\n")
    df = io.read_csv_by_header(spark, d, {"k": "bigint"}, source="file")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3
    assert df.columns == ["k", "a", "b", "file", "c, quoted"]
    rows = {r.k: r for r in df.collect()}
    assert sorted(rows) == list(range(1000)) and rows[3].file.endswith("f0003.csv")
    assert (rows[0].a, rows[0].b, rows[1].b, rows[1].a, rows[2]["c, quoted"]) == ("x", None, "y", None, "z, 2")


def test_guessed_types_with_late_surprises(spark):
    d = tempfile.mkdtemp(prefix="lk-io-")
    head = "i,r,t,d,ts,code,late,none,mixed\n"
    row = "{i},{i}.5,TRUE,2024-01-{d:02},2024-01-02 03:04:05,007,{i},NA,{m}\n"
    write(d, "a.csv", head + "".join(row.format(i=i, d=1 + i % 28, m=i) for i in range(1500)))
    # what all of the first file's columns look like no longer holds here
    write(d, "b.csv", head + "-3,Inf,F,2024-02-29,2024-01-02,12,oops,NA,2024-01-01\n,1e-5,,,,,,,\n")
    got = io.read_csv_guess(spark, d)
    assert got.types == {"i": "bigint", "r": "double", "t": "boolean", "d": "date", "ts": "timestamp", "code": "string",
                         "late": "string", "none": "boolean", "mixed": "string"}
    assert got.problems.count() == 0
    last = got.data.where("i = -3").first()
    assert last.r == float("inf") and last.t is False and last.d == dt.date(2024, 2, 29) and last.ts == dt.datetime(2024, 1, 2)
    # a share that need not fit: such values are listed, and NULL
    some = io.read_csv_guess(spark, d, allow=0.01)
    assert some.types["late"] == "bigint" and some.types["mixed"] == "bigint"
    assert sorted(map(tuple, some.problems.collect())) == [("late", "oops", "bigint", 1), ("mixed", "2024-01-01", "bigint", 1)]
    assert some.data.where("late IS NULL").count() == 2 and some.data.count() == 1502
    told = io.read_csv_guess(spark, d, types={"i": "string", "late": "int"})
    assert told.data.schema["i"].dataType.simpleString() == "string" and told.problems.count() == 1


def test_guess_lattice(spark):
    df = spark.createDataFrame([("1", "1", "2024-02-30", "TRUE"), ("2.0", "T", "2024-01-01", "1"), (None, None, None, None)],
                               "num string, no string, day string, no2 string")
    assert io.guess_types(df) == {"num": "double", "no": "string", "day": "string", "no2": "string"}
    assert io.guess_types(df.where("num IS NULL")) == dict.fromkeys(df.columns, "boolean")
    assert io.guess_types(df.select(df.num.cast("double"))) == {}


def test_a_file_that_breaks_is_named(spark):
    """A .gz cut in the middle gives its first rows and is named; sound files
    around it are whole."""
    import gzip
    d = tempfile.mkdtemp(prefix="lk-io-")
    text = "game_pk,game_date,pitcher\n" + "".join(f"{i},2024-04-01,{i * 7919 % 100003}\n" for i in range(60_000))
    for name in ("a", "b", "c", "d", "e"):
        with gzip.open(os.path.join(d, f"{name}.csv.gz"), "wt") as f:
            f.write(text)
    for name in ("b", "e"):
        path = os.path.join(d, f"{name}.csv.gz")
        whole = open(path, "rb").read()
        with open(path, "wb") as f:
            f.write(whole[:len(whole) // 2])
    got = io.tolerant_read(spark, d, SCHEMA)
    assert sorted(os.path.basename(x) for x in got.broken) == ["b.csv.gz", "e.csv.gz"]
    assert all("Exception" in x for x in got.broken.values())
    files = {os.path.basename(r.file): r for r in got.files.collect()}
    assert all(files[f"{x}.csv.gz"].rows == 60_000 and files[f"{x}.csv.gz"].complete for x in "acd")
    assert all(not files[f"{x}.csv.gz"].complete and files[f"{x}.csv.gz"].rows < 60_000 for x in "be")
    assert got.good.count() + got.bad.count() == sum(r.rows for r in files.values())


def test_broken_files_by_halves():
    from pyspark.errors import PySparkException
    calls = []

    def read(files):
        calls.append(len(files))
        if any(x in (3, 64) for x in files):
            raise PySparkException("broken")
    assert io.broken_files(read, list(range(100))) == {3: "broken", 64: "broken"}
    assert len(calls) < 2 * 2 * 8
    assert io.broken_files(read, [5, 6]) == {}
