"""What a physical plan must not hold."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame

_SINGLE_WINDOW = re.compile(r"Window(GroupLimit)? [^\n]*\n[^\n]*?(Sort [^\n]*\n[^\n]*?)?(Exchange|ShuffleQueryStage[^\n]*\n[^\n]*?Exchange) SinglePartition")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_faults(df: DataFrame) -> list[str]:
    """Cross products, nested loops, and windows over a table in one task (an
    exchange to a single partition right below a window or its sort)."""
    plan = plan_text(df)
    found = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin") if x in plan]
    return found + ["window in a single partition"] * len(_SINGLE_WINDOW.findall(plan))
