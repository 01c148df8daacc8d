"""Near-duplicates: SimHash fingerprints linked by Hamming distance, or sets of shingles by Jaccard similarity; components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import drop_table, free_name, table, written
from brindle.llm.graph import components

SEED = 42
BITS = 64
CHUNK = 8192
#: Fingerprints in one bucket up to which all its pairs are compared; larger ones are linked by near values.
SMALL_BUCKET = 64
#: Near copies by Jaccard similarity: words in a shingle, and the similarity that makes a link.
NEAR_WIDTH = 5
NEAR_SIMILARITY = 0.8
#: Bits up to which their fingerprints link first.
PRINT_DISTANCE = 2
#: Shingles known as common are ordered last; found in one text of COMMON_SHARE, COMMON_MOST at most. They only save time.
COMMON_SHARE = 16
COMMON_MOST = 1 << 16
#: Least longs of a set's parities, and most that go along while pairs are joined (longer ones are asked afterwards).
PARITY_LEAST = 8
PARITY_JOINED = 32


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the text in lower case (A-Z only); of the whole if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the text's shingles; 0 for a text without words."""
    return simhash(shingle_hashes(text, width))


def fingerprints(text: Column, width: int) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(
            np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64), pa.int64()
        )

    return of.asNondeterministic()(text)


def _masks(distance: int, spare: int) -> list[int]:
    """Masks of the block sets that must agree: of distance + spare blocks any ``spare`` can be untouched."""
    blocks = distance + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(kept) for kept in combinations(parts, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, distance: int, spare: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints ``fp`` (distinct) at ``distance`` (0 to 2) or fewer bits.

    Fingerprints that close agree on ``spare`` whole blocks of distance + spare, and are joined on
    those. Buckets of up to SMALL_BUCKET fingerprints compare their pairs. In a larger one every
    fingerprint is dealt to the values near it in the bits left free: two share a value only if they
    are close enough, so that each value (which few can share) links its members to their least,
    without all pairs. No bucket is capped and every link holds.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = _masks(distance, spare)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)).bitwiseAND(F.col("fp")) for m in masks])).alias("way", "key"))
    sizes = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keyed.join(sizes, ["way", "key"]), "buckets")
    small = sized.where(F.col("n") <= SMALL_BUCKET)
    pairs = (
        small.select("way", "key", F.col("fp").alias("a"))
        .join(small.select("way", "key", F.col("fp").alias("b")), ["way", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    large = sized.where(F.col("n") > SMALL_BUCKET)
    if distance == 0 or large.isEmpty():
        return pairs.distinct()
    return pairs.unionAll(_by_near_values(large, masks, distance)).distinct()


def _by_near_values(large: DataFrame, masks: list[int], distance: int) -> DataFrame:
    free = [[_signed(1 << k) for k in range(BITS) if not mask >> k & 1] for mask in masks]
    flips = F.create_map(*[x for way, bits in enumerate(free) for x in (F.lit(way), F.array(*map(F.lit, bits)))])
    flip = F.explode(flips[F.col("way")])
    if distance == 1:
        # Two that differ in one bit are equal once it is set.
        near = large.select("fp", flip.alias("flip")).select("fp", "flip", F.col("fp").bitwiseOR(F.col("flip")).alias("near"))
    else:
        # Two at distance 1 or 2 are both within one bit of some value, and two within one bit of it are at most 2 apart.
        near = (
            large.select("fp", flip.alias("flip"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
            .unionAll(large.select("fp", F.col("fp").alias("near")))
            .withColumn("flip", F.lit(0))
        )
    near = near.distinct()
    least = near.groupBy("flip", "near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, ["flip", "near"]).select("a", F.col("fp").alias("b")).where("a < b")


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    """One row for each row of docs: id, digest, fp and component, its component's least fingerprint."""
    text = F.col(f"`{text_col}`").cast("string")
    prints = written(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), fingerprints(text, width).alias("fp")),
        "prints",
    )
    linked = components(near_links(prints.select("fp").distinct(), distance))
    return prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("id", "digest", "fp", F.coalesce("component", "fp").alias("component"))


def classes(docs: DataFrame, id_col: str, text_col: str, *, width: int = 3, distance: int = 2) -> DataFrame:
    """One row for each row of docs: ``id``, ``digest`` (of the text), ``fp`` and ``component_id``.

    component_id is the smallest id reachable over links of at most ``distance`` bits, itself
    included. Texts without words (null, empty, white space) share fingerprint 0. Repeated rows
    stay; a null id takes part but never names a component unless all its members are null. An
    empty table gives an empty one; other columns of docs are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    prints = written(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), fingerprints(text, width).alias("fp")),
        "prints",
    )
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(near_links(distinct.select("fp"), distance))
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = labelled.join(
        labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component"
    ).select("fp", "component_id")
    return prints.join(named, "fp").select("id", "digest", "fp", "component_id")


def _kept(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each component of found (id, digest, component)."""
    one, digest = free_name(docs, "one"), free_name(docs, "digest")
    kept = found.groupBy("component").agg(F.min_by(F.struct("id", "digest"), F.struct(F.col("id").isNull(), "id", "digest")).alias("one"))
    kept = kept.select(F.col("one.id").alias(one), F.col("one.digest").alias(digest)).distinct()
    text = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    joined = docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(one)) & (text == F.col(digest)))
    return joined.dropDuplicates([id_col, digest]).drop(one, digest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, distance: int = 2) -> DataFrame:
    """docs with one row of each component: that of the smallest id, then of the smallest text hash.

    All columns stay. Components are told apart by their fingerprints, so null and repeated ids cost no other text.
    """
    return _kept(docs, _labelled(docs, id_col, text_col, width, distance), id_col, text_col)


def shared_least(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with any set this similar to it."""
    return math.ceil(similarity * n - 1e-9)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """First shingles of a set in one order of all shingles: two sets this similar share one of their prefixes."""
    if not len(shingles):
        return shingles
    place = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        place = np.where(common[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, place))][: len(shingles) - shared_least(len(shingles), similarity) + 1]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bit k tells whether an odd number of the set's shingles fall to k; two sets differ in as many shingles as bits, at least.

    At least two bits a shingle, in a power of 2 of longs; the upper half folds onto the lower by XOR.
    """
    longs = max(PARITY_LEAST, 1 << max(0, math.ceil(len(shingles) / 32) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_be_similar(n: Column, m: Column, left: Column, right: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles with these parities can reach the similarity; so if one's parities are null.

    No similar pair fails: it differs in (1 - similarity) / (1 + similarity) of its shingles at most, and its parities in no more bits.
    """
    sizes = F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9
    longs = F.least(F.size(left), F.size(right))

    def folded(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, 1, longs), F.slice(x, longs + 1, longs), lambda y, z: y.bitwiseXOR(z))
        return F.when(F.size(x) == 2 * longs, halves).otherwise(x)

    bits = F.aggregate(F.zip_with(folded(left), folded(right), lambda y, z: F.bit_count(y.bitwiseXOR(z))), F.lit(0), lambda y, z: y + F.coalesce(z, F.lit(0)))
    return sizes & F.coalesce(bits <= F.lit((1 - similarity) / (1 + similarity)) * (n + m) + 1e-9, F.lit(True))


_SETS = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("parity", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_SETS_TYPE = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("parity", "tokens"))])


def _shingle_sets(text: Column, width: int) -> Column:
    """The set of a text's shingle hashes, sorted, as bytes."""

    @F.arrow_udf(T.BinaryType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in texts], pa.binary())

    return of.asNondeterministic()(text)


def _prefixes(text: Column, width: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> Column:
    """(node, n, fp, parity, tokens): digest, size, SimHash, parities and prefix of a text's set of shingles."""

    @F.arrow_udf(_SETS_TYPE)
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = np.unique(shingle_hashes(t.as_py(), width))
            node = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))
            first = prefix(found, common, rank, similarity).view(np.int64)
            out.append({"node": node, "n": len(found), "fp": _signed(simhash(found)), "parity": parities(found), "tokens": first})
        return pa.array(out, _SETS)

    return of.asNondeterministic()(text)


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that stand in several of a share of the texts, and their ranks by frequency."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(column: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in column], pa.list_(pa.int64()))

    some = texts.where(F.pmod("digest", F.lit(COMMON_SHARE)) == 0).dropDuplicates(["digest"])
    counted = some.select(F.explode(of.asNondeterministic()("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "token").limit(COMMON_MOST).collect()
    tokens = np.array([r.token for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], len(rows) - order


def _similar(similarity: float):
    """Whether two sets are this similar."""

    @F.arrow_udf(T.BooleanType())
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    return of.asNondeterministic()


def _similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets of shingles are this similar. Only sets that parities don't tell apart are moved."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    open_ = pairs.join(a, "a").join(b, "b").where(_may_be_similar(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), similarity))
    open_ = written(open_.select("a", "b"), "open")
    needed = open_.select(F.col("a").alias("node")).unionAll(open_.select("b")).distinct()
    # A node has one digest here: copies go where the join has put them, and texts are moved and sorted once.
    one_text = texts.join(nodes.select("node", "digest").join(needed, "node"), "digest").dropDuplicates(["digest"])
    sets = written(one_text.select("node", _shingle_sets(F.col("text"), width).alias("shingles")), "sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    found = written(open_.join(left, "a").join(right, "b").where(_similar(similarity)("sa", "sb")).select("a", "b"), "similar")
    drop_table(open_)
    drop_table(sets)
    return found


def _print_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that connect all whose SimHash is equal or as close as the distance: blocks, then bits."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least_of_prints")
    equal = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = near_links(least.select("fp"), distance).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    close = close.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return equal.unionAll(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _similar_labelled(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """id, digest and component of each row, by links between all texts whose sets of shingles reach a Jaccard similarity.

    SimHash first: sets whose fingerprints are PRINT_DISTANCE bits apart, by blocks as in near_links(). At 0.8 fingerprints differ in some
    10 bits, too many for blocks, so the rest is found exactly: of one order of all shingles (common ones last), two such sets share
    one among their first fifth. Sets first meet the least one at each shared shingle; only pairs that this leaves in different
    components meet each other, and of these only such as their parities don't tell apart. So a large group of near
    copies costs a link for each member and the pairs that are similar or nearly so. Every link is checked on whole sets; none is missed.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    texts = rows.select("digest", "text")
    found = rows.select("id", "digest", _prefixes(F.col("text"), width, similarity, *_common(texts, width)).alias("s"))
    prints = written(found.select("id", "digest", "s.*"), "prints")
    nodes = written(prints.select("node", "digest", "n", "fp", "parity").dropDuplicates(["node"]), "nodes")
    tokens = prints.select("node", "n", F.posexplode("tokens").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q").select("token")
    again = written(tokens.join(shared, "token").distinct(), "tokens")
    sizes = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9
    least = again.groupBy("token").agg(F.min(F.struct("node", "n")).alias("o")).select("token", F.col("o.node").alias("a"), F.col("o.n").alias("m"))
    starts = again.join(least, "token").where((F.col("node") > F.col("a")) & sizes).select("a", F.col("node").alias("b"))
    starts = written(starts.unionAll(_print_pairs(nodes, PRINT_DISTANCE)).distinct(), "pairs")
    links = _similar_pairs(starts, nodes, texts, width, similarity)
    joined = again.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = written(joined, "labelled")
    drop_table(again)
    mixed = joined.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("p")).where("x <> y").select("token", "p")
    left = joined.join(mixed, "token").where("node <> p").drop("p")
    left = written(left.join(nodes.select("node", F.when(F.size("parity") <= PARITY_JOINED, F.col("parity")).alias("parity")), "node"), "mixed")
    drop_table(joined)
    other = left.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("component").alias("of"), F.col("parity").alias("by"))
    rest = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) * (1 + similarity) >= F.lit(similarity) * (F.col("n") + F.col("m")) - 1e-9
    apart = (F.col("node") < F.col("b")) & (F.col("component") != F.col("of"))
    pairs = left.join(other, "token").where(apart & rest & _may_be_similar(F.col("n"), F.col("m"), F.col("parity"), F.col("by"), similarity))
    pairs = written(pairs.select(F.col("node").alias("a"), "b").distinct().join(starts, ["a", "b"], "left_anti"), "pairs")
    drop_table(left)
    labels = components(links.unionAll(_similar_pairs(pairs, nodes, texts, width, similarity)))
    return prints.select("id", "digest", "node").join(labels, "node", "left").select("id", "digest", F.coalesce("component", "node").alias("component"))


def similar_classes(docs: DataFrame, id_col: str, text_col: str, *, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """Like classes(), with links between all texts whose sets of shingles reach a Jaccard similarity: id, digest, component_id."""
    labelled = _similar_labelled(docs, id_col, text_col, width, similarity)
    named = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    return labelled.join(named, "component").select("id", "digest", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """docs with one row of each component of similar_classes(): chosen as by keep_one()."""
    return _kept(docs, _similar_labelled(docs, id_col, text_col, width, similarity), id_col, text_col)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )
