"""Repeated-string removal against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from brindle.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            places[d[p : p + length]].append((i, p))
    gone = [bytearray(len(d)) for d in data]
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for d, g in zip(data, gone, strict=True):
        kept = bytes(b for b, x in zip(d, g, strict=True) if not x)
        spans = sum(1 for p in range(len(g)) if g[p] and not (p and g[p - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é日"
    word = lambda n: "".join(rng.choices(letters, k=n))
    passages = [word(rng.randrange(10, 60)) for _ in range(6)]
    out = [None, "", "a", "aaaa" * 30, "abab" * 20, "abc" * 40, word(200)]
    for _ in range(60):
        out.append("".join(rng.choice([word(rng.randrange(0, 25)), rng.choice(passages), rng.choice(passages)[rng.randrange(5) :]]) for _ in range(rng.randrange(1, 6))))
    return [*out, out[-1], out[-1], out[20], word(9), "zz" + out[6]]


def run(spark, rows, length, gram):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, cls string").repartition(3)
    got = {r.doc_id: r.removed for r in suffix.remove_repeats(df, length=length, gram=gram).collect()}
    assert len(got) == len(rows)
    want = brute(rows, length)
    for i, w in enumerate(want):
        g = got[i]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == w, (i, rows[i])
        assert hashlib.sha256(bytes(g.kept)).hexdigest() == g.kept_sha256


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    run(spark, texts(seed), 16, 6)


def test_hot_anchors_and_small_bins(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BIN_CONTEXTS", 2)
    monkeypatch.setattr(suffix, "BIN_BYTES", 100)
    monkeypatch.setattr(suffix, "CHUNK", 20)
    run(spark, texts(3), 16, 6)


def test_production_length(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefghij ", k=260))
    rows = ["".join(rng.choices("abcdefghij ", k=rng.randrange(0, 500))) + passage[rng.randrange(40) :] + "".join(rng.choices("klm", k=rng.randrange(9))) for _ in range(40)]
    run(spark, [*rows, "x" * 5000, "x" * 199, "x" * 200, rows[0]], 200, 64)


def test_suffix_array():
    rng = random.Random(1)
    for n in (*range(30), 400):
        for letters in (1, 2, 30):
            s = [rng.randrange(letters) for _ in range(n)]
            assert suffix.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(df).count() == 0


def test_bins_by_suffixes_alone():
    rng = random.Random(5)
    text = "".join(rng.choices("ab", k=300)).encode()
    contexts = [text[i : i + rng.randrange(5, 60)] for i in range(0, 260, 20)] + [text[40:90], b"q" * 30, b"q" * 30]
    places = [(1, i) for i in range(0, 260, 20)] + [(1, 40), (2, 0), (3, 0)]
    at = defaultdict(set)
    for c, (k, b) in zip(contexts, places, strict=True):
        for x in range(len(c) - 7):
            at[c[x : x + 8]].add((k, b + x))
    want = [[x for x in range(len(c) - 7) if len(at[c[x : x + 8]]) > 1] for c in contexts]
    assert [x.tolist() for x in suffix.repeated_windows(contexts, places, 8)] == want
    assert [x.tolist() for x in suffix._by_suffixes(contexts, places, 8)] == want
