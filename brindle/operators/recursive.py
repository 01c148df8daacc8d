"""Recursive UNION: a fix point that drops rows already seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.files import written


def fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """All rows reachable from first by step; each pass sees only the rows that are new, and cycles end it.

    Rows are compared null-safe in all columns. Every pass is written to the shared folder, which cuts lineage and
    survives lost executors.
    """
    columns = first.columns
    work = written(first.distinct())
    parts = [work]
    for _ in range(limit):
        new = step(work).toDF(*columns).select(*[F.col(c).cast(work.schema[c].dataType) for c in columns]).distinct()
        for seen in parts:
            new = new.alias("n").join(
                seen.alias("s"), [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns], "left_anti"
            )
        work = written(new)
        if work.isEmpty():
            break
        parts.append(work)
        if len(parts) > 16:
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionAll(p)
            parts = [written(merged)]
    else:
        raise RuntimeError(f"recursion did not end in {limit} passes")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
