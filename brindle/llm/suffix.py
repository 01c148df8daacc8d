"""Exact substring removal: suffix arrays by the difference-cover algorithm over candidate contexts.

A string of ``length`` bytes that occurs twice has the same anchors in both places: an anchor is a
gram whose hash is the least of some window of grams, so it depends on nothing outside the string.
Only contexts of anchors that occur twice can hold repeated strings. Equal contexts need no
sorting; the others are dealt to bins by anchor, and each bin is sorted as a suffix array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import drop_table, table, written

LENGTH = 200
GRAM = 64
CHUNK = 1 << 18
#: Bytes of contexts in one bin, about, and contexts of one anchor up to which it stays whole in its bin.
BIN_BYTES = 1 << 20
BIN_CONTEXTS = 12_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_power_tables = [_powers(1)]


def gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, the same wherever it stands."""
    n = len(flat)
    if len(_power_tables[0][0]) < n:
        _power_tables[0] = _powers(2 * n)
    up, down = _power_tables[0]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat + np.uint64(1)) * up[:n], out=sums[1:])
        out = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def sliding(values: np.ndarray, width: int, combine: np.ufunc, neutral: int) -> np.ndarray:
    """combine over each run of ``width`` values, in three passes whatever the width."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, neutral, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = combine.accumulate(blocks, axis=1).ravel()
    behind = combine.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return combine(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of grams that are the least of some window: every string of ``length`` bytes holds one."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.empty(0, np.int64)
    found = []
    for at in range(0, n - length + 1, CHUNK):
        flat = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, n - at), at).astype(np.uint64)
        hashes = gram_hashes(flat, gram)
        least = sliding(hashes, width, np.minimum, np.iinfo(np.uint64).max)
        edge = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
        found.append(np.flatnonzero(most == hashes) + at)
    return np.unique(np.concatenate(found))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ANCHOR = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("key", "ctx", "ctx2", "pos")]))


def _anchors_of(length: int, gram: int):
    digest, wide = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest

    @F.arrow_udf(ANCHOR)
    def of(texts: pa.Array) -> pa.Array:
        offsets, keys, contexts, places = [0], [], [], []
        for t in texts:
            data = (t.as_py() or "").encode()
            for p in anchors(data, length, gram).tolist():
                left = max(0, p - length + gram)
                keys.append(digest(data[p : p + gram]))
                contexts.append(wide(data[left : p + length], p - left))
                places.append(p)
            offsets.append(len(keys))
        both = np.frombuffer(b"".join(contexts), np.int64).reshape(-1, 2)
        cells = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.array(places, np.int64))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, ["key", "ctx", "ctx2", "pos"]))

    return of.asNondeterministic()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by the difference cover {1, 2} modulo 3.

    Triples at sampled starts are sorted and named; equal names are told apart by the suffix array of the
    names. Suffixes at the other starts are sorted by their first value and the sampled rank behind it, and merged in.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([np.unique(s, return_inverse=True)[1] + 1, np.zeros(3, np.int64)]).astype(np.int64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    pair = s[:-1] * (s.max() + 1) + s[1:]
    pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[sampled] * (s.max() + 1) + s[sampled + 2]
    names = np.unique(triple, return_inverse=True)[1].astype(np.int64)
    rank = np.zeros(n + 3, np.int64)
    if names.max() + 1 < len(names):
        order = suffix_array(np.concatenate([names[: len(one)] + 1, names[len(one) :] + 1]))
    else:
        order = np.empty(len(names), np.int64)
        order[names] = np.arange(len(names))
    first = sampled[order]
    rank[first] = np.arange(1, len(first) + 1)
    first = first[first < n]
    zero = np.arange(0, n, 3)
    scale = np.int64(n + 4)
    zero = zero[np.argsort(s[zero] * scale + rank[zero + 1], kind="stable")]
    ones, twos = first[first % 3 == 1], first[first % 3 == 2]
    by_one = np.searchsorted(s[ones] * scale + rank[ones + 1], s[zero] * scale + rank[zero + 1])
    by_two = np.searchsorted(pair[twos] * scale + rank[twos + 2], pair[zero] * scale + rank[zero + 2])
    out = np.empty(n, np.int64)
    places = np.arange(len(zero)) + by_one + by_two
    out[places] = zero
    rest = np.ones(n, bool)
    rest[places] = False
    out[rest] = first
    return out


def _by_suffixes(strings: list[bytes], places: list[tuple[int, int]], length: int) -> list[np.ndarray]:
    """For each string the starts (in it) of runs of ``length`` bytes that also start at another place.

    Neighbours in the suffix array are compared by their first ``length`` bytes.
    """
    sizes = np.array([len(c) for c in strings], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(text)) - begins[owner]
    order = suffix_array(text.astype(np.int64))
    order = order[inside[order] + length <= sizes[owner[order]]]
    same = np.zeros(max(0, len(order) - 1), bool)
    span = np.arange(length)
    for at in range(0, len(same), 4096):
        b = order[at + 1 : at + 4097]
        a = order[at : at + len(b)]
        same[at : at + len(b)] = (text[a[:, None] + span] == text[b[:, None] + span]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    classes = np.array([p[0] for p in places], np.int64)[owner[order]]
    starts = np.array([p[1] for p in places], np.int64)[owner[order]] + inside[order]
    by = np.lexsort((starts, classes, run))
    changes = (np.diff(run[by]) == 0) & ((np.diff(classes[by]) != 0) | (np.diff(starts[by]) != 0))
    several = np.zeros(len(order) + 1, bool)
    several[run[by][1:][changes]] = True
    hit = np.zeros(len(text), bool)
    hit[order[several[run]]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def repeated_windows(contexts: list[bytes], places: list[tuple[int, int]], length: int) -> list[np.ndarray]:
    """For each context the starts (in it) of strings of ``length`` bytes that also start at another place.

    places: class and position of each context's first byte; contexts that overlap in a text hold the same
    places, which count once. Before anything is sorted, strings are named by hash. Those whose name occurs
    once can't repeat and are dropped; stretches of the others that are equal byte for byte repeat. The suffix
    array decides on all names left, each from two places.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    out = [np.empty(0, np.int64)] * len(contexts)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    if len(text) < length:
        return out
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(text)) - begins[owner]
    valid = np.flatnonzero(inside + length <= sizes[owner])
    _, names, counts = np.unique(gram_hashes(text.astype(np.uint64), length)[valid], return_inverse=True, return_counts=True)
    again = counts[names] > 1
    at, names = valid[again], names[again]
    if not len(at):
        return out
    home = owner[at]
    classes, starts = np.array([p[0] for p in places], np.int64)[home], np.array([p[1] for p in places], np.int64)[home] + inside[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(home) != 0)])).tolist()
    stretches: dict[bytes, list[int]] = {}
    for f, e in zip(first, [*first[1:], len(at)], strict=True):
        stretches.setdefault(text[at[f] : at[e - 1] + length].tobytes(), []).append(f)
    repeats = np.zeros(len(counts), bool)
    single: list[tuple[int, int]] = []
    for s, members in stretches.items():
        own = slice(members[0], members[0] + len(s) - length + 1)
        if len({(classes[f], starts[f]) for f in members}) > 1:
            repeats[names[own]] = True
        else:
            single.append((own.start, own.stop))
    # What is still open is sorted, but no string at more than two places.
    seen, seen_class, seen_start = np.zeros(len(counts), np.int8), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    chosen = []
    for f, e in single:
        open_ = f + np.flatnonzero(~repeats[names[f:e]] & (seen[names[f:e]] < 2))
        known = seen[names[open_]] == 1
        open_ = open_[~known | (seen_class[names[open_]] != classes[open_]) | (seen_start[names[open_]] != starts[open_])]
        if len(open_):
            own = names[open_]
            seen_class[own], seen_start[own] = classes[open_], starts[open_]
            seen[own] += 1
            chosen.append((int(open_[0]), int(open_[-1]) + 1))
    if chosen:
        strings = [text[at[f] : at[e - 1] + length].tobytes() for f, e in chosen]
        for (f, _), hit in zip(chosen, _by_suffixes(strings, [(classes[f], starts[f]) for f, _ in chosen], length), strict=True):
            repeats[names[f + hit]] = True
    hits = repeats[names]
    cut = np.searchsorted(home[hits], np.arange(len(contexts) + 1))
    found = inside[at[hits]]
    return [found[cut[i] : cut[i + 1]] for i in range(len(contexts))]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered stretches of strings of ``length`` bytes that begin at ``starts`` (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


SPAN = "cls long, begin long, end long"
_span_schema = pa.schema([("cls", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _bin(length: int):
    def sort(key, held):
        cells = held["bytes"].to_pylist()
        places = list(zip(held["cls"].to_pylist(), held["begin"].to_pylist(), strict=True))
        out = [(c, b + x, b + y) for (c, b), starts in zip(places, repeated_windows(cells, places, length), strict=True) for x, y in spans_of(starts, length)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_span_schema)

    return sort


CONTEXT = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("bytes", T.BinaryType())]))


def _cut_contexts(length: int, gram: int):
    """Contexts of wanted anchors (key, pos) of a text."""

    @F.arrow_udf(CONTEXT)
    def of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, w in zip(texts, wanted, strict=True):
            data = t.as_py().encode()
            out.append([{"key": x["key"], "begin": (b := max(0, x["pos"] - length + gram)), "bytes": data[b : x["pos"] + length]} for x in w.as_py()])
        return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("begin", pa.int64()), ("bytes", pa.binary())])))

    return of.asNondeterministic()


WINDOWS = T.ArrayType(T.StructType([T.StructField("window", T.BinaryType()), T.StructField("at", T.LongType())]))


def _windows_of(length: int):
    @F.arrow_udf(WINDOWS)
    def of(contexts: pa.Array, begins: pa.Array) -> pa.Array:
        out = []
        for c, b in zip(contexts.to_pylist(), begins.to_pylist(), strict=True):
            out.append([{"window": xxhash.xxh3_128_digest(c[i : i + length]), "at": b + i} for i in range(len(c) - length + 1)])
        return pa.array(out, pa.list_(pa.struct([("window", pa.binary()), ("at", pa.int64())])))

    return of.asNondeterministic()


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(cls, begin, end): stretches of bytes covered by strings that start elsewhere too.

    texts: rows (cls, text), where equal texts have one cls; each cls counts as one text, so that
    what copies of whole texts share must be added. Stretches of a cls may overlap.
    """
    left = length - gram
    found = written(texts.select("cls", F.explode(_anchors_of(length, gram)("text")).alias("a")).select("a.key", "a.ctx", "a.ctx2", "cls", F.col("a.pos").cast("int").alias("pos")), "anchors")
    place = F.xxhash64("cls", "pos")
    keys = found.groupBy("key").agg(
        F.min(place).alias("p"), F.max(place).alias("q"), F.min("ctx").alias("c"), F.max("ctx").alias("d"), F.min("ctx2").alias("c2"), F.max("ctx2").alias("d2")
    )
    keys = written(keys.where("p <> q").select("key", ((F.col("c") == F.col("d")) & (F.col("c2") == F.col("d2"))).alias("alike")), "keys")
    # Anchors that occur at two places. The join is written first, so that it can split the rows of a frequent anchor.
    met = written(found.join(keys, "key"), "met")
    drop_table(found)
    # Copies of a text give equal rows.
    again = written(met.distinct(), "repeated")
    drop_table(met)
    mixed = again.where("not alike")
    counts = mixed.groupBy("key", "ctx", "ctx2").agg(F.count("*").alias("n"), F.min(F.struct("cls", "pos")).alias("one"))
    counts = written(counts, "contexts")
    begin = F.greatest(F.col("pos") - left, F.lit(0)).cast("long")
    whole = (F.col("pos") + length).cast("long")
    equal = again.where("alike").select("cls", begin.alias("begin"), whole.alias("end"))
    equal = equal.unionAll(mixed.join(counts.where("n > 1").select("key", "ctx", "ctx2"), ["key", "ctx", "ctx2"]).select("cls", begin.alias("begin"), whole.alias("end")))
    # One context of each kind is cut from its text, to be sorted with the others of its anchor.
    wanted = counts.select("one.cls", F.struct("key", "one.pos").alias("w")).groupBy("cls").agg(F.collect_list("w").alias("wanted"))
    one_text = texts.join(wanted, "cls").groupBy("cls").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    cut = one_text.select("cls", F.explode(_cut_contexts(length, gram)("text", "wanted")).alias("c"))
    cut = written(cut.select("cls", "c.key", "c.begin", "c.bytes"), "cut")
    hot = counts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BIN_CONTEXTS).select("key")
    total = cut.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bins = max(1, -(-total // BIN_BYTES))
    some_hot = not hot.isEmpty()
    cool = cut.join(hot, "key", "left_anti") if some_hot else cut
    dealt = cool.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    spans = equal.unionAll(dealt.groupBy("bin").applyInArrow(_bin(length), SPAN))
    if some_hot:
        # Contexts of one anchor beyond a bin: their strings are counted by hash instead, map-side first.
        windows = written(
            cut.join(hot, "key", "left_semi").select("cls", F.explode(_windows_of(length)("bytes", "begin")).alias("w")).select("cls", "w.window", "w.at"), "windows"
        )
        at = F.struct("cls", "at")
        twice = windows.groupBy("window").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x <> y").select("window")
        spans = spans.unionAll(windows.join(twice, "window").select("cls", F.col("at").alias("begin"), (F.col("at") + length).alias("end")))
    return spans


REMOVED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    + [T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())]
)
_removed_type = pa.struct(
    [(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")]
    + [("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
)


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        e = min(e, n)
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif b < e:
            out.append([b, e])
    return [tuple(x) for x in out]


def _cut_out(length: int, with_bytes: bool):
    @F.arrow_udf(REMOVED)
    def of(texts: pa.Array, begins: pa.Array, ends: pa.Array, copied: pa.Array) -> pa.Array:
        rows = []
        for t, b, e, c in zip(texts, begins.to_pylist(), ends.to_pylist(), copied.to_pylist(), strict=True):
            data = (t.as_py() or "").encode()
            n = len(data)
            spans = [(0, n)] if c and n >= length else merged(list(zip(b, e, strict=True)), n) if b else []
            kept, at = [], 0
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            kept = b"".join([*kept, data[at:]])
            rows.append((n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [list(s) for s in spans], kept if with_bytes else None))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _removed_type, strict=True)], fields=list(_removed_type))

    return of.asNondeterministic()


def remove_repeats(docs: DataFrame, text_col: str = "text", into: str = "removed", *, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """docs with one more struct column: sizes, spans and what is kept once each byte of a repeated string is gone.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text
    or another; strings are judged on the input and never cross texts. A null text is empty. Rows of equal texts are
    copies of each other, and lose everything if they have ``length`` bytes. All rows and columns stay;
    a column called ``into`` (in any case) is an error. An empty table stays empty. Texts are told apart by XXH64; should
    two texts ever have the same, a second hash tells, and that is an error. Contexts are told apart by 128 bits.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"column '{into}' exists")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cls = F.xxhash64(text)
    long = docs.select(cls.alias("cls"), text.alias("text")).where(F.octet_length("text") >= length)
    spans = repeated_spans(long, length, gram).groupBy("cls").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    other = F.xxhash64("text", F.lit(length))
    copies = long.groupBy("cls").agg(F.count("*").alias("n"), F.min(other).alias("a"), F.max(other).alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("n") > 1).otherwise(F.raise_error(F.lit("two texts have one hash")).cast("boolean"))
    copies = copies.select("cls", one.alias("copied"))
    facts = written(copies.join(spans, "cls", "left").where("copied or begins is not null").withColumnRenamed("cls", f"{into}_cls"), "spans")
    joined = docs.join(facts, cls == facts[f"{into}_cls"], "left")
    out = joined.withColumn(into, _cut_out(length, with_bytes)(text, facts["begins"], facts["ends"], F.coalesce(facts["copied"], F.lit(False))))
    return out.drop(*(facts[c] for c in facts.columns))


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
    return out.select("doc_id", *[F.col(f"removed.{n}").alias(n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
