"""Mixing: targets against a plain loop, budgets against enumeration, shares of documents."""

import random
from collections import defaultdict

import pytest

from brindle.llm import mixing


def brute_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def test_fit_meets_the_budget(monkeypatch):
    rng = random.Random(2)
    for program in (1 << 20, 7):
        monkeypatch.setattr(mixing, "PROGRAM_WORDS", program)
        for _ in range(60):
            lengths = sorted(rng.sample(range(0, 40), 6))
            counts = [rng.randrange(1, 4) for _ in lengths]
            whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
            budget = rng.randrange(0, whole + 5)
            take = mixing.fit(lengths, counts, budget)
            got = sum(n * t for n, t in zip(lengths, take, strict=True))
            assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and got <= budget
            if budget >= whole:
                assert got == whole
            assert budget - got <= max(lengths)


def test_program_is_exact():
    rng = random.Random(4)
    for _ in range(80):
        lengths = rng.sample(range(1, 30), 5)
        counts = [rng.randrange(0, 6) for _ in lengths]
        budget = rng.randrange(0, 150)
        found = mixing._program(lengths, counts, budget)
        assert all(k <= counts[i] for i, k in found.items())
        assert sum(lengths[i] * k for i, k in found.items()) == brute_sum(lengths, counts, budget)


def plain_targets(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Water is poured by weight; full sources give what runs over to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    got, weight = dict.fromkeys(order, 0.0), {s: weights[i % 3] for i, s in enumerate(order)}
    left = total * sum(sizes.values())
    while left > 1e-9:
        thirsty = [s for s in order if got[s] < most * sizes[s] - 1e-9]
        if not thirsty:
            break
        unit = left / sum(weight[s] for s in thirsty)
        for s in thirsty:
            drunk = min(unit * weight[s], most * sizes[s] - got[s])
            got[s] += drunk
            left -= drunk
    return got


def test_targets_against_a_plain_loop(spark):
    rng = random.Random(3)

    def found(sizes, **options):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        rows = mixing.targets(df, **options).collect()
        assert {r.source: r.source_size for r in rows} == sizes
        return {r.source: r.target for r in rows}

    assert found({"b": 10, "a": 10, None: 10}) == pytest.approx({"a": 20.0, "b": 25 / 3, None: 50 / 3})
    assert found({"a": 0}) == {"a": 0.0} and found({}) == {}
    for n in (2, 7, 60):
        sizes = {rng.choice("aBé") + str(i): int(10 ** rng.uniform(0, 5)) for i in range(n)} | {None: 50, "": 0}
        assert found(sizes) == pytest.approx(plain_targets(sizes))
    assert found({"a": 5, "b": 9}, total=9.0) == {"a": 10.0, "b": 18.0}


def rows():
    rng = random.Random(8)
    out = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "B", "c", None, "a", "a"])) for i in range(400)]
    return out + [(1000, None, "a"), (None, "x y z", "c"), (1001, "q " * 5000, "B"), (5, "same", "a"), (5, "same", "a")]


@pytest.mark.parametrize("bucket", [100_000, 3])
def test_sources_meet_their_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    df = spark.createDataFrame([(*r, 7) for r in rows()], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows())
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.times in (0, 1, 2) and (r.size > 0 or r.times == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.times
        goal[r.source] = r.target
    assert goal == pytest.approx(plain_targets(sizes))
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal if s != "B") and abs(taken["B"] - goal["B"]) <= 5000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_mixed_repeats_rows(spark):
    df = spark.createDataFrame([(*r, 7) for r in rows()], "doc_id long, text string, source string, times int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = sum(r.times for r in mixing.mix(df).collect())
    assert out.count() == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    assert mixing.mixed(df).count() == 0
