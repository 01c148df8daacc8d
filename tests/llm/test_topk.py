"""Exact top-k against brute force."""

import math
import random

import pytest

from brindle.llm import topk


def brute(vectors, queries, k):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        w = [math.floor(256 * x) for x in v]
        return w if all(abs(x) < 2**63 for x in w) else None

    kept = [(i, w) for i, v in vectors if i is not None and (w := whole(v))]
    out = []
    for q, v in queries:
        if q is None or not (a := whole(v)):
            continue
        held = lambda n: max(min(n, 2**63 - 1), 1 - 2**63)
        scores = sorted((-held(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in kept if i != q and len(a) == len(b))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows(scale):
    rng = random.Random(6)
    out = [(i, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(8)]) for i in range(300)]
    out += [(300 + i, out[0][1]) for i in range(40)]  # ties
    out += [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [0.5] * 8)]
    out += [(100, out[100][1]), (905, [1e30] * 8)]  # a repeated query row, components too large for a long
    return out + [(950, [1.0, 2.0]), (1000, [2.0, 1.0]), (1050, [1.0, 2.0, 3.0]), (7, out[7][1])]


@pytest.mark.parametrize("scale", [0.2, 3e5, 1e7, 1e15])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", 8)
    monkeypatch.setattr(topk, "GROUP_ROWS", 3)
    monkeypatch.setattr(topk, "SHARD_EXTREMES", 10)
    data = rows(scale)
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, dim string")
    queries = [r for r in data if r[0] is not None and r[0] % 50 == 0]
    got = topk.top_k(df.repartition(3), df.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()
    assert sorted(map(tuple, got)) == brute(data, queries, 5)


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), "vec_id", "embedding").collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), df, "vec_id", "embedding").count() == 0
    assert topk.top_k(df, df.limit(0), "vec_id", "embedding").count() == 0


def test_blocks_below_the_kth_stay(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = random.Random(2)
    data = []
    for i in range(640):
        centre = i // 32
        data.append((i, [(3.0 if j == centre else 0.0) + rng.random() / 10 for j in range(20)]))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1)
    queries = [r for r in data if r[0] in (0, 50)]
    moved = []
    got = topk.top_k(df, df.where("vec_id in (0, 50)"), "vec_id", "embedding", moved=moved).collect()
    assert sorted(map(tuple, got)) == brute(data, queries, 5)
    assert moved[0] <= moved[1] // 4
