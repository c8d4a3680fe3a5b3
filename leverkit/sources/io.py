"""Readers (declared and guessed types, very many files), writers, tolerant
ingest and the date spine."""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None,
                 required: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; ``columns`` prunes at the scan, ``required`` fails fast
    when the file lacks a column the caller depends on."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {paths}")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
             header: bool = True, null_value: str = "NA", date_format: str = "yyyy-MM-dd",
             drop: Sequence[str] = ()) -> DataFrame:
    """CSV with a declared schema (no inference pass); one reader over a
    list of files or a glob is the row-bind of all of them.  ``drop``
    removes noise columns such as a written-out row-name column."""
    paths = [path] if isinstance(path, str) else list(path)
    df = (spark.read.schema(schema).option("header", header).option("nullValue", null_value)
               .option("dateFormat", date_format).option("mode", "PERMISSIVE").csv(paths))
    return df.drop(*drop) if drop else df


def read_many(spark: SparkSession, paths: Sequence[str], reader) -> DataFrame:
    """Row-bind frames with differing columns by name (missing -> NULL)."""
    frames = [reader(spark, p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line, in one pass over all of them: the first line
    of a file is the one that comes first of those in its first block.  One row
    a file reaches the driver, which listed the files to begin with."""
    lines = (spark.read.text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start")
             .where("file_block_start = 0").withColumn("_at", F.monotonically_increasing_id()))
    first = lines.groupBy("file_path").agg(F.min_by("value", "_at").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file_path").collect():
        out.setdefault(r["header"], []).append(r["file_path"])
    return out


def read_csv_by_header(spark: SparkSession, path: str | Sequence[str], types: dict[str, str] | None = None,
                       null_value: str = "NA", source: str | None = None, **options) -> DataFrame:
    """Row-bind of very many CSV files by column name (missing -> NULL).

    Files are grouped by their header, so the plan has one scan a distinct
    header, not one a file.  ``types`` maps names to types; other columns are
    strings.  ``source`` adds a column with each row's file.
    """
    paths, types = [path] if isinstance(path, str) else list(path), types or {}
    options = {"header": True, "nullValue": null_value, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True} | options
    out = None
    for header, files in csv_headers(spark, paths).items():
        # Spark's own CSV parser reads the header line, quotes and all
        names = spark.createDataFrame([(header,)], "h string").select(F.from_csv(
            "h", ", ".join(f"c{i} string" for i in range(header.count(",") + 1))).alias("r")).first()["r"]
        names = [n for n in names if n is not None]
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(types[n]) if n in types else T.StringType()) for n in names])
        df = spark.read.schema(schema).options(**options).csv(files)
        if source:
            df = df.withColumn(source, F.input_file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no line in {paths}")
    return out


# --- types from narrow to wide; what a text must look like (a number that
# begins with a needless zero is a code, not a number)
_WHOLE = r"^[+-]?(0|[1-9][0-9]{0,17})$"
_REAL = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(Inf|inf|NaN)$"
_TRUTH = r"^(T|F|TRUE|FALSE|true|false|True|False)$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z?$"


def _as_type(c, kind: str):
    """A text as a value of ``kind``; NULL if it does not fit."""
    if kind == "boolean":
        return F.when(c.rlike(_TRUTH), F.upper(F.substring(c, 1, 1)) == "T")
    if kind == "bigint":
        return F.when(c.rlike(_WHOLE), c.try_cast("bigint"))
    if kind == "double":
        return F.when(c.rlike(_REAL), F.regexp_replace(c, "(?i)inf$", "Infinity").try_cast("double"))
    if kind == "date":
        return F.when(c.rlike(_DAY), c.try_cast("date"))
    if kind == "timestamp":
        return F.when(c.rlike(_DAY) | c.rlike(_TIME), c.try_cast("timestamp"))
    return c


KINDS = ["boolean", "bigint", "double", "date", "timestamp"]


class GuessedRead(NamedTuple):
    data: DataFrame
    #: type of each column
    types: dict[str, str]
    #: values that do not fit the type of their column: column, value, expected, rows
    problems: DataFrame


def guess_types(df: DataFrame, allow: float = 0.0) -> dict[str, str]:
    """The narrowest type of each string column that all its values fit, or all
    but the share ``allow`` of them.

    One aggregate over all rows: per column, the values and how many fit each
    type; the types form a lattice (whole number below number, date below
    timestamp, all below text), so counts of parts add up and nothing depends
    on which rows come first.  A column without a value is boolean, as an
    all-missing column is.
    """
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"n{i}"))
        aggs += [F.count_if(_as_type(x, k).isNotNull()).alias(f"{k}{i}") for k in KINDS]
    r = df.agg(*aggs).first()
    return {c: next((k for k in KINDS if r[f"n{i}"] - r[f"{k}{i}"] <= allow * r[f"n{i}"]), "string") for i, c in enumerate(cols)}


def read_csv_guess(spark: SparkSession, path: str | Sequence[str], null_value: str = "NA", allow: float = 0.0,
                   types: dict[str, str] | None = None) -> GuessedRead:
    """CSV scan that finds the column types from all rows of all files.

    ``types`` declares some of them.  With ``allow`` a few values may not fit:
    they become NULL and are listed, with their number, in ``problems``.
    """
    raw = read_csv_by_header(spark, path, null_value=null_value)
    found = guess_types(raw, allow) | (types or {})
    return GuessedRead(raw.select(*[(_as_type(F.col(f"`{c}`"), found[c]) if found[c] in KINDS
                                     else F.col(f"`{c}`").try_cast(found[c])).alias(c) for c in raw.columns]),
                       found, _misfits(raw, found))


def _misfits(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    rows = []
    for c, k in types.items():
        x = F.col(f"`{c}`")
        cast = _as_type(x, k) if k in KINDS else x.try_cast(k)
        rows.append(F.when(x.isNotNull() & cast.isNull(), F.struct(F.lit(c).alias("column"), x.alias("value"), F.lit(k).alias("expected"))))
    return (raw.select(F.explode(F.array_compact(F.array(*rows))).alias("p")).select("p.*")
            .groupBy("column", "value", "expected").agg(F.count(F.lit(1)).alias("rows")))


class TolerantRead(NamedTuple):
    good: DataFrame
    bad: DataFrame
    #: files that gave no record: unreadable or empty
    skipped: list[str]
    #: files whose read ended early, with the error; their earlier rows are in ``good`` and ``bad``
    broken: dict[str, str]
    #: per file: rows, bad_rows, complete
    files: DataFrame


def broken_files(read, files: Sequence[str]) -> dict[str, str]:
    """Files that can't be read to their end, with the error.

    ``read(files)`` runs a strict read of some files.  All are tried at once;
    a group that fails is tried again by halves, so that b broken files of n
    take about b * log2(n) further reads of ever fewer files, and none if all
    are sound.  Only Spark's readers touch the files.
    """
    try:
        read(list(files))
        return {}
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1:
            lines = [x for x in str(e).splitlines() if "Exception" in x] or [str(e)]
            return {files[0]: lines[-1].strip()[:300]}
    half = len(files) // 2
    return broken_files(read, files[:half]) | broken_files(read, files[half:])


def tolerant_read(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                  fmt: str = "csv", header: bool = True, null_value: str = "NA",
                  corrupt_col: str = "_corrupt_record") -> TolerantRead:
    """Bulk ingest that keeps going past bad input.

    Malformed records are split off (with their raw text) instead of failing
    the job.  The files are first read strictly, in one pass; only if that
    fails are the broken ones found (``broken_files``) and what they give up to
    the break is kept and accounted for: ``broken`` names them, ``files`` has
    the rows that each file gave and whether its read came to its end.  The
    parsed input is written once to the shared folder and all parts read that
    copy.
    """
    paths = [path] if isinstance(path, str) else list(path)
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])

    def scan(files, tolerant: bool) -> DataFrame:
        r = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
             .option("ignoreCorruptFiles", str(tolerant).lower()))
        if fmt == "csv":
            r = r.option("header", header).option("nullValue", null_value)
        return r.format(fmt).load(files).withColumn("_source_file", F.input_file_name())

    given = scan(paths, True).inputFiles()
    shared_dir(spark)
    broken: dict[str, str] = {}
    try:
        # which records are malformed depends on all columns being parsed, so
        # the split must not be recomputed from a pruned scan
        df = scan(paths, False).checkpoint(eager=True)
    except (PySparkException, Py4JJavaError):
        broken = broken_files(lambda files: scan(files, False).write.format("noop").mode("overwrite").save(), sorted(given))
        df = scan(paths, True).checkpoint(eager=True)
    counts = df.groupBy("_source_file").agg(F.count(F.lit(1)).alias("rows"), F.count(corrupt_col).alias("bad_rows"))
    every = spark.createDataFrame([(f, f not in broken) for f in given], "file string, complete boolean")
    files = (every.join(counts, F.col("file") == F.col("_source_file"), "left")
             .select("file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), "complete"))
    skipped = sorted(r["file"] for r in files.where("rows = 0").collect())  # one row a file at most
    good = df.where(F.col(corrupt_col).isNull()).drop(corrupt_col, "_source_file")
    bad = df.where(F.col(corrupt_col).isNotNull()).select(corrupt_col, "_source_file")
    return TolerantRead(good, bad, skipped, broken, files)


def write_csv(df: DataFrame, path: str, header: bool = True, partition_by: Sequence[str] = ()):
    w = df.write.mode("overwrite").option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()):
    """Parquet sink; partition plate-appearance tables by season so later
    reads prune whole directories."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, by: Sequence[str], buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table under the shared folder, dealt into ``buckets``
    by ``by`` (and sorted inside by ``by`` and ``sort``), and read it back.

    Windows, aggregates and joins on ``by`` (or on more columns than ``by``)
    then need no exchange, and joins of two tables with the same buckets
    neither.  Rows are dealt out once before the write, so each bucket is one
    file, not one a task.
    """
    w = df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{table}"
    w.sortBy(*by, *sort).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def date_spine(spark: SparkSession, start: str, end: str, name: str = "day") -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive."""
    return spark.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias(name))


def date_spine_from(df: DataFrame, date_col: str, name: str = "day") -> DataFrame:
    """Day spine covering the dates of a column (one tiny aggregate)."""
    b = df.agg(F.min(date_col).alias("_a"), F.max(date_col).alias("_z"))
    return b.select(F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias(name))


def save_model(model, path: str):
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
