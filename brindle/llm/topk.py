"""Exact top-k by integer inner product: document-range blocks in order of their bounds, until bounds fall below the kth.

Bounds of all blocks come from their extremes, a small table. A first round scores each query's best block and so
gives a score that its kth reaches; after it only blocks are moved whose bound reaches that of some query of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import table, written

SCALE = 256.0
K = 5
#: Vectors in one block, which has its terms' extremes and its forward index (the vectors themselves).
BLOCK_ROWS = 256
#: Blocks that one task scores against one group of queries, extremes that it bounds, and queries in a group.
SHARD_BLOCKS = 64
SHARD_EXTREMES = 4096
GROUP_ROWS = 2048
EXACT, LONG = 2.0**53, 2.0**63
NONE = np.iinfo(np.int64).min


def _whole(value: Column) -> Column:
    """Vectors as floor(SCALE * x) in longs; null where the vector is null, empty or holds a component that is null, not finite or too large for a long."""
    ok = value.isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LONG / SCALE)
    )
    return F.when(ok, F.transform(value, lambda x: F.floor(F.lit(SCALE) * x.cast("double"))))


def _blocks(size: int):
    """Rows (id, vector) of one length, packed ``size`` at a time: ids, extremes of each term and vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, rows: list) -> pa.RecordBatch:
            ids = np.concatenate([r[0] for r in rows])
            vectors = np.concatenate([r[1] for r in rows])
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            cells = [ids.tobytes(), vectors.max(axis=0).tobytes(), vectors.min(axis=0).tobytes(), vectors.tobytes()]
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "first": pa.array([int(ids[0])], pa.int64())}
                | {n: pa.array([c], pa.binary()) for n, c in zip(("ids", "most", "least", "vectors"), cells, strict=True)}
            )

        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                vectors = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                at = 0
                while at < len(own):
                    rows = held.setdefault(dim, [])
                    room = size - sum(len(r[0]) for r in rows)
                    rows.append((ids[own[at : at + room]], vectors[at : at + room]))
                    at += room
                    if at <= len(own) and sum(len(r[0]) for r in rows) == size:
                        yield block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield block(dim, rows)

    return pack


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in longs, or in whole numbers of any size that are then held to a long's range."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < LONG / 4:
        return a @ b.T
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ends.min + 1, ends.max).astype(np.int64)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and block the sum over terms of the largest product that the block can hold."""
    return _products(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([most, least]))


def _array(cell: bytes, dim: int | None = None) -> np.ndarray:
    flat = np.frombuffer(cell, np.int64)
    return flat if dim is None else flat.reshape(-1, dim)


def _queries_of(queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and scores to reach of a group's queries (NONE: nothing to reach)."""
    dim = queries["dim"][0].as_py()
    ids, vectors = (np.concatenate([_array(x.as_py(), d) for x in queries[c]]) for c, d in (("ids", None), ("vectors", dim)))
    reach = queries["reach"][0].as_py() if "reach" in queries.column_names else None
    return ids, vectors, np.full(len(ids), NONE) if reach is None else _array(reach)


def _bounds_of(q: np.ndarray, blocks: pa.Table) -> np.ndarray:
    return _bounds(q, *(np.concatenate([_array(x.as_py(), q.shape[1]) for x in blocks[c]]) for c in ("most", "least")))


_FIRST = pa.schema([("group", pa.int64()), ("place", pa.int32()), ("bound", pa.int64()), ("block", pa.int64())])


def _best_blocks(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """For each query the block of the highest bound in this shard."""
    if not len(queries) or not len(blocks):
        return _FIRST.empty_table()
    _, q, _ = _queries_of(queries)
    bounds = _bounds_of(q, blocks)
    best = bounds.argmax(axis=1)
    group = np.full(len(q), key[1].as_py())
    return pa.table({"group": group, "place": np.arange(len(q), dtype=np.int32), "bound": bounds[np.arange(len(q)), best], "block": blocks["block"].to_numpy()[best]}, schema=_FIRST)


_WANTED = pa.schema([("group", pa.int64()), ("block", pa.int64())])


def _blocks_to_reach(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """Blocks of this shard whose bound reaches the score of some query."""
    if not len(queries) or not len(blocks):
        return _WANTED.empty_table()
    _, q, reach = _queries_of(queries)
    wanted = blocks["block"].to_numpy()[(_bounds_of(q, blocks) >= reach[:, None]).any(axis=0)]
    return pa.table({"group": np.full(len(wanted), key[1].as_py()), "block": wanted}, schema=_WANTED)


_FOUND = pa.schema([("group", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _score(k: int):
    def score(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(queries) or not len(blocks):
            return _FOUND.empty_table()
        q_ids, q, reach_of = _queries_of(queries)
        dim = q.shape[1]
        cells = [(_array(i.as_py()), _array(v.as_py(), dim)) for i, v in zip(blocks["ids"], blocks["vectors"], strict=True)]
        bounds = _bounds_of(q, blocks)
        best = np.full((len(q), k), NONE)
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        filled = np.zeros((len(q), k), bool)
        ranking = np.argsort(-bounds, axis=1, kind="stable")
        # The nth round scores each query's nth block; queries that share it are scored at once.
        alive = np.ones(len(q), bool)
        for n in range(len(cells)):
            own = ranking[:, n]
            reach = bounds[np.arange(len(q)), own]
            alive &= (reach >= reach_of) & (~filled[:, -1] | (reach >= best[:, -1]))
            if not alive.any():
                break
            for b in np.unique(own[alive]).tolist():
                rows = np.flatnonzero(alive & (own == b))
                ids, vectors = cells[b]
                scores = _products(q[rows], vectors)
                valid = (ids[None, :] != q_ids[rows][:, None]) & (scores >= reach_of[rows][:, None])
                all_scores = np.concatenate([best[rows], scores], axis=1)
                all_ids = np.concatenate([best_ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
                all_filled = np.concatenate([filled[rows], valid], axis=1)
                # Unfilled places sort last; by score, then by id.
                order = np.lexsort((all_ids, ~all_scores, ~all_filled), axis=1)[:, :k]
                best[rows] = np.take_along_axis(all_scores, order, 1)
                best_ids[rows] = np.take_along_axis(all_ids, order, 1)
                filled[rows] = np.take_along_axis(all_filled, order, 1)
        at = np.nonzero(filled)
        return pa.table({"group": np.full(len(at[0]), key[1].as_py()), "place": at[0].astype(np.int32), "query_id": q_ids[at[0]], "vec_id": best_ids[at], "score": best[at]}, schema=_FOUND)

    return score


def _reaching(k: int):
    @F.arrow_udf(T.BinaryType())
    def of(ids: pa.Array, kths: pa.Array) -> pa.Array:
        """The score that each query of a group reaches, from (place, score) pairs of those known."""
        out = []
        for i, known in zip(ids, kths.to_pylist(), strict=True):
            reach = np.full(len(i.as_py()) // 8, NONE)
            for x in known or []:
                reach[x["place"]] = x["score"]
            out.append(reach.tobytes())
        return pa.array(out, pa.binary())

    return of.asNondeterministic()


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = K, *, moved: list | None = None) -> DataFrame:
    """The k best rows of vectors for each row of queries: query_id, rank (from 1), vec_id, score.

    Both tables have the id and vector columns; a row is no candidate for a query of its own
    id. Scores are inner products of floor(256 * x); ties go to the smaller id. Vectors that are null, empty or
    hold null or non-finite components take no part, nor do null ids, nor vectors with a component whose floor(256 * x) doesn't
    fit a long; vectors of other lengths than a query's are no candidates for it. Rows of repeated ids each count: as candidates,
    and as queries with ranks of their own. Scores beyond a long's range are held to its ends. A query without candidates, and
    an empty table, give no rows.

    Vectors are packed in blocks of ids close to each other. The extremes of all blocks meet every group of queries: each
    query's best block is scored first, then the blocks whose bound reaches what the query has by then; in a task
    each query takes them by falling bound and stops below its kth score. moved, if given, receives the numbers of (group, block)
    pairs that were moved and of all pairs.
    """
    blocks, groups = (
        written(
            t.select(F.col(f"`{id_col}`").cast("long").alias("id"), _whole(F.col(f"`{vector_col}`")).alias("vector"))
            .where("id is not null and vector is not null")
            .repartitionByRange("id")
            .mapInArrow(_blocks(size), "dim int, first long, ids binary, most binary, least binary, vectors binary")
            .withColumn(name, F.monotonically_increasing_id()),
            f"{name}s",
        )
        for t, size, name in ((vectors, BLOCK_ROWS, "block"), (queries, GROUP_ROWS, "group"))
    )
    keys = ("dim", "group", "shard")
    sizes = written(groups.select("dim", "group"), "sizes")

    def sharded(left: DataFrame, right: DataFrame, shards: int) -> tuple:
        """Groups and blocks, each group once for every shard."""
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        dealt = right.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
        return left.select(*[c for c in left.columns if c not in ("most", "least", "first")], each).groupBy(*keys), dealt.groupBy(*keys)

    count = max(1, blocks.count())
    extremes = blocks.select("block", "dim", "most", "least").join(sizes, "dim")
    shards = -(-count // SHARD_BLOCKS)

    def scored(left: DataFrame, wanted: DataFrame) -> DataFrame:
        moving = blocks.join(wanted, "block").select("block", "dim", "group", "ids", "most", "least", "vectors")
        a, b = sharded(left, moving, shards)
        return a.cogroup(b).applyInArrow(_score(k), "group long, place int, query_id long, vec_id long, score long")

    a, b = sharded(groups, extremes, -(-count // SHARD_EXTREMES))
    best = a.cogroup(b).applyInArrow(_best_blocks, "group long, place int, bound long, block long")
    best = best.groupBy("group", "place").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = written(best.select("group", "block").distinct(), "first")
    start = written(scored(groups, first), "start")
    by_query = Window.partitionBy("group", "place").orderBy(F.desc("score"), "vec_id")
    start = start.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k)
    kth = start.where(F.col("n") == k).groupBy("group").agg(F.collect_list(F.struct("place", "score")).alias("known"))
    reaching = written(groups.join(kth, "group", "left").withColumn("reach", _reaching(k)("ids", "known")).drop("known"), "reaching")
    a, b = sharded(reaching, extremes, -(-count // SHARD_EXTREMES))
    more = a.cogroup(b).applyInArrow(_blocks_to_reach, "group long, block long").join(first, ["group", "block"], "left_anti")
    more = written(more, "more")
    if moved is not None:
        moved += [first.count() + more.count(), extremes.count()]
    found = written(scored(reaching, more), "found").unionByName(start.drop("n"))
    rank = F.row_number().over(by_query)
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.n, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
