"""Hot-group check: one game key holding about a third of the events.

Runs the same lead (next value inside a game, in event order) with the
plain window and with the split-safe primitive, checks the results are
identical, and reports the largest number of rows any one window task
processed in each case.

usage: python tools/skew_check.py [sf_dir] [partitions]
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from leverkit.plans.ordered import lead_in_group  # noqa: E402
from leverkit.session import get_spark  # noqa: E402


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    spark = get_spark("local[8]", shuffle_partitions=parts,
                      extra={"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    ev = spark.read.parquet(f"{d}/events.parquet")
    # every user whose id is divisible by 3 plays in one game: a hot key
    df = ev.select(F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
                   .alias("game"), "event_id", "value")
    n = df.count()
    hot = df.where("game = 0").count()
    out = {"rows": n, "hot_game_rows": hot}
    results = {}
    for name, limit in (("plain_window", n + 1), ("split_safe", max(1, n // parts))):
        t0 = time.perf_counter()
        r = lead_in_group(df, ["game"], ["event_id"], ["value"], max_rows=limit) \
            .withColumn("_task", F.spark_partition_id())
        r = r.cache()
        per_task = r.groupBy("_task").count().agg(F.max("count")).first()[0]
        results[name] = {(x.event_id, x.next_value) for x in r.select("event_id", "next_value").collect()}
        out[name] = {"max_rows_in_one_task": per_task, "sec": round(time.perf_counter() - t0, 2)}
        r.unpersist()
    out["identical"] = results["plain_window"] == results["split_safe"]
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
