"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_table, written

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hands its larger (or smaller) neighbours to its smallest neighbour.

    The smallest neighbour comes from a map-side combined min, so that a hub costs one row
    for each task; the join back is an ordinary one, which adaptive execution splits where a hub is hot.
    """
    if large:
        links = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = links.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _shape(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that edges (a, b) name.

    Only counts reach the driver. Null ends and loops are left out; an empty table gives an
    empty result. Every round is written to the shared folder.
    """
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    shape = _shape(current)
    for _ in range(MAX_ROUNDS):
        if not shape[0]:
            break
        following = written(_star(_star(current, True), False), "links")
        drop_table(current)
        current, before = following, shape
        shape = _shape(current)
        if shape == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        current.select("b", "b").distinct()
    )
