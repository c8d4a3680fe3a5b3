"""Session and shared-folder helpers."""
from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # delete checkpoint files of intermediates once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "leverkit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on.  On a cluster pass master=None
    and let spark-submit decide; tests use local[*]."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is also the only executor
        conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and intermediate tables.

    Read from the session's ``spark.checkpoint.dir``.  Only a local-mode
    session (tests, the bench) without one gets a fresh temp folder; on a
    cluster an unset folder is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="leverkit-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scale_conf(input_bytes: int, total_cores: int,
               target_partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Shuffle and scan sizing for a given input size.

    Start from about one shuffle partition per 128 MB of input (at least
    3 waves of the cores) and let AQE coalesce small ones and split skewed
    ones at run time.  100 TB gives ~800k initial partitions, capped at
    200k, which AQE coalesces toward the advisory size.
    """
    initial = max(3 * total_cores, min(200_000, input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, in case
    it is neither installed nor on their path (with ``--py-files`` it is)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])


MATERIALIZE_CONF = "leverkit.materialize"


def materialize(df):
    """Write an intermediate that several branches consume to the shared
    checkpoint folder and continue from the written copy.

    This cuts the lineage (a lost executor recomputes from the checkpoint,
    not from the raw scans) and keeps the plan from duplicating the
    upstream work into every branch.  Disabled with
    ``leverkit.materialize=false``.
    """
    spark = df.sparkSession
    if (spark.conf.get(MATERIALIZE_CONF, "true") or "true").lower() != "true":
        return df
    shared_dir(spark)
    return df.checkpoint(eager=True)
