"""File-stream ingest with a quarantine for malformed records."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir


def ingest_landed_files(spark: SparkSession, source_dir: str, schema: T.StructType,
                        good_path: str, bad_path: str, fmt: str = "csv",
                        checkpoint: str | None = None, partition_by: tuple[str, ...] = (),
                        null_value: str = "NA", corrupt_col: str = "_corrupt_record",
                        max_files_per_trigger: int | None = None) -> dict:
    """Process every file not seen before in ``source_dir`` and stop.

    Good rows go to parquet under ``good_path/batch_id=<n>`` (optionally
    partitioned further), malformed records with their raw text under
    ``bad_path/batch_id=<n>``.  A batch overwrites its own folders, so one that
    is tried again after a failure between or in its writes leaves no
    duplicate.  Uses ``trigger(availableNow=True)``: the same code serves a
    one-off backfill and a scheduled incremental run.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
    r = (spark.readStream.schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", corrupt_col))
    if fmt == "csv":
        r = r.option("header", True).option("nullValue", null_value)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = r.format(fmt).load(source_dir).withColumn("_source_file", F.input_file_name())
    ckpt = checkpoint or os.path.join(shared_dir(spark), "ingest-" +
                                      os.path.basename(os.path.normpath(good_path)))
    counts = {"good": 0, "bad": 0}

    def write_batch(batch: DataFrame, batch_id: int):
        seen = {name: Observation() for name in counts}
        good = batch.where(F.col(corrupt_col).isNull()).drop(corrupt_col)
        bad = batch.where(F.col(corrupt_col).isNotNull())  # all fields are parsed, so that all are checked
        parts = {"good": (good, good_path, partition_by), "bad": (bad, bad_path, ())}
        for name, (rows, path, by) in parts.items():
            w = rows.observe(seen[name], F.count(F.lit(1)).alias("n")).write.mode("overwrite")
            (w.partitionBy(*by) if by else w).parquet(f"{path}/batch_id={batch_id}")
        for name in counts:
            counts[name] += seen[name].get["n"]

    q = (stream.writeStream.foreachBatch(write_batch)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return counts
