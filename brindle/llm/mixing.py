"""Mixing sources to target weights by subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import free_name, table, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
EPOCHS = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Budget that is left for the dynamic program, in words; a bit set of so many bits is a megabyte.
PROGRAM_WORDS = 1 << 20
#: Documents of one source and length that one task ranks; more are dealt to several buckets first.
BUCKET_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total=TOTAL, epochs=EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size): words to take from each source.

    Shares of total * all words by weight, none above epochs * its source's size. Sources get the weights in turn, in order of code
    points with null last: they are numbered within ranges of that order. What is above a source's limit is shared among
    the others by weight, again and again; as a share only grows, each round is one sum over the sources beyond their limit.
    """
    ranges = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranges = written(ranges.withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r.part, r["count"]) for r in ranges.groupBy("part").count().collect())
    offsets, before = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    if not before:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    place = F.create_map(*offsets)[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limited = written(ranges.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("limit")), "limits")
    whole = limited.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    unit, closed = total * whole.n / whole.w, -1
    while True:
        above = limited.where(F.lit(unit) * F.col("weight") > F.col("limit")).agg(F.count("*").alias("n"), F.sum("limit").alias("l"), F.sum("weight").alias("w")).first()
        if above.n in (closed, before):
            break
        closed = above.n
        unit = (total * whole.n - (above.l or 0.0)) / (whole.w - (above.w or 0.0))
    share = F.lit(unit) * F.col("weight")
    return limited.select("source", "source_size", F.when(share > F.col("limit"), F.col("limit")).otherwise(share).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length (at most its count) to take for a sum close to budget, never above.

    Every length gives its proportional share first, rounded down; then one more of each, from
    the longest on, while the budget left is beyond the program's size. The rest is fitted
    exactly where it can be: bounded-knapsack dynamic programming over a bit set of reachable
    sums, each length's count split in powers of two. Where no subset meets the budget, the largest
    reachable sum below is taken.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [0] * len(lengths)
    if whole <= budget:
        return list(counts)
    if budget <= 0:
        return take
    take = [c * budget // whole for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while left > PROGRAM_WORDS:
        before = left
        for i in order:
            if take[i] < counts[i] and lengths[i] <= left and left > PROGRAM_WORDS:
                more = min(counts[i] - take[i], max(1, (left - PROGRAM_WORDS) // (lengths[i] * len(lengths)))) if lengths[i] else 0
                more = min(more, left // lengths[i]) if lengths[i] else 0
                take[i] += more
                left -= more * lengths[i]
        if left == before:
            break
    if left > PROGRAM_WORDS:
        # Only documents longer than the program's budget remain beside what is taken.
        usable = [i for i in order if take[i] < counts[i] and lengths[i] <= left]
        for i in usable:
            more = min(counts[i] - take[i], left // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    for i, t in _program(lengths, [c - t for c, t in zip(counts, take, strict=True)], min(left, PROGRAM_WORDS)).items():
        take[i] += t
    return take


def _program(lengths: list[int], spare: list[int], budget: int) -> dict[int, int]:
    """Items of the subset of the largest sum up to budget: {position: number}."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (n, c) in enumerate(zip(lengths, spare, strict=True)):
        if not n or n > budget:
            continue
        c, step = min(c, budget // n), 1
        while c > 0 and not reached[budget]:
            step = min(step, c)
            w = step * n
            new = reached[: budget + 1 - w] & ~reached[w:]
            by[w:][new] = len(items)
            items.append((i, step))
            reached[w:] |= new
            c -= step
            step *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    found: dict[int, int] = {}
    while at:
        i, step = items[by[at]]
        found[i] = found.get(i, 0) + step
        at -= step * lengths[i]
    return found


PLAN = "source string, source_size long, target double, size long, n long, base long, extra long"


def _plan(key, held):
    """How often each document of a source's lengths is taken, and how many of them once more."""
    held = held.sort_by("size")
    lengths, counts = held["size"].to_pylist(), held["n"].to_pylist()
    whole, target = held["source_size"][0].as_py(), held["target"][0].as_py()
    base = int(target // whole) if whole else 0
    extra = fit(lengths, counts, round(target) - base * whole)
    held = held.append_column("base", pa.array([base] * len(lengths), pa.int64())).append_column("extra", pa.array(extra, pa.int64()))
    return held.select([f.split()[0] for f in PLAN.split(", ")])


def shares(docs: DataFrame, size: str, source: str, order: str, *, weights=WEIGHTS, total=TOTAL, epochs=EPOCHS) -> DataFrame:
    """docs (narrow rows) with source_size, target and ``times``: how often the mix takes each row.

    ``order`` is a column of seeded hashes: of the documents of one source and length those of the
    smallest take the part round. Lengths are counted map-side, so that one row for
    each source and length is all that a source's plan holds. Documents of one source and length beyond
    BUCKET_ROWS are ranked in several buckets by ranges of the hash, each counted
    first. A null source is a source; documents without words are never taken.
    """
    counted = written(docs.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n")), "lengths")
    goals = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, epochs)
    goals = goals.withColumnRenamed("source", "goal_source")
    lengths = counted.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    plan = written(lengths.groupBy("source").applyInArrow(_plan, PLAN), "plan")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    unit = F.col(order).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    planned = docs.join(
        plan.withColumnsRenamed({"source": "plan_source", "size": "plan_size"}),
        F.col(source).eqNullSafe(F.col("plan_source")) & (F.col(size) == F.col("plan_size")),
    ).drop("plan_source", "plan_size")
    planned = planned.withColumn("bucket", F.least(F.floor(unit * buckets), buckets - 1))
    # Only groups that give a part of their rows need ranks.
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    every = planned.where(~partial).withColumn("taken_now", (F.col("extra") > 0).cast("long"))
    part = planned.where(partial)
    keys = [source, size]
    cells = part.groupBy(*keys, "bucket").agg(F.count("*").alias("cell"))
    before = F.sum("cell").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col(source).alias("c_source"), F.col(size).alias("c_size"), F.col("bucket").alias("c_bucket"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = part.join(
        cells,
        F.col(source).eqNullSafe(F.col("c_source")) & (F.col(size) == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket")),
    ).drop("c_source", "c_size", "c_bucket")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(order, *[c for c in docs.columns if c not in (source, size, order)]))
    ranked = ranked.withColumn("taken_now", (rank + F.col("before") <= F.col("extra")).cast("long")).drop("before")
    out = every.unionByName(ranked)
    return out.withColumn("times", F.when(F.col(size) > 0, F.col("base") + F.col("taken_now")).otherwise(F.lit(0)).cast("long")).drop(
        "n", "base", "extra", "bucket", "taken_now"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, total=TOTAL, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """Narrow rows (id, digest, source, size, source_size, target, times), one for each row of docs.

    The order in which documents are chosen is a seeded hash of id and text, so reruns agree; rows that
    are equal in both are interchangeable. Null ids and texts take part (a null text has size 0).
    An empty table gives no rows; other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    narrow = written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.xxhash64(text).alias("digest"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(text).alias("size"),
        ).withColumn("luck", F.xxhash64(F.lit(seed), "id", "digest")),
        "sizes",
    )
    return shares(narrow, "size", "source", "luck", weights=weights, total=total, epochs=epochs).drop("luck")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: a row taken twice is there twice; all columns stay."""
    names = {c: free_name(docs, f"mix_{c}") for c in ("id", "digest", "source", "times")}
    chosen = mix(docs, id_col, text_col, source_col, **options).groupBy("id", "digest", "source").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    chosen = chosen.where("times > 0").select(*[F.col(c).alias(n) for c, n in names.items()], F.col("rows").alias(free_name(docs, "mix_rows")))
    rows, number, times = free_name(docs, "mix_rows"), free_name(docs, "mix_number"), F.col(names["times"])
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.join(
        chosen,
        F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"]))
        & (F.xxhash64(text) == F.col(names["digest"]))
        & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(names["source"])),
    )
    # Repeated rows share one entry: each gets its even part, the first ones (in any order, for they are equal) one more.
    single = joined.where(F.col(rows) == 1).withColumn(number, F.lit(1))
    several = joined.where(F.col(rows) > 1).withColumn(number, F.row_number().over(Window.partitionBy(*names.values()).orderBy(names["digest"])))
    dealt = single.unionByName(several)
    copies = F.floor(times / F.col(rows)) + (F.col(number) <= times % F.col(rows)).cast("long")
    drop = [*names.values(), rows, number]
    repeated = free_name(docs, "mix_copy")
    return dealt.withColumn(repeated, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop(*drop, repeated)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )
