"""SimHash classes against a brute-force version."""

import random
from itertools import combinations

import numpy as np
import xxhash

from brindle.llm import simhash


def brute_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    grams = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """prints: (id, fp) pairs; the smallest id of each row's component."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [least.get(root(i)) for i in range(len(prints))]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choices(words, k=150))
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE TWO three", "É é", "x " * 3000]
    texts += [base] * 3 + [base.upper()]
    for _ in range(60):
        changed = base.split()
        changed[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(60)]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts, 1)] + [(3, ""), (3, "")]


def check(spark, rows, distance=2):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(df, "doc_id", "text", distance=distance).collect() if r.id)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((i, p, c) for (i, p), c in zip(prints, brute_components(prints, distance), strict=True) if i)
    assert got == want


def test_against_brute_force(spark):
    for distance in (0, 1, 2):
        check(spark, corpus(), distance)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 1)
    for distance in (1, 2):
        check(spark, corpus(), distance)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(df, "doc_id", "text").count() == 0
    assert simhash.keep_one(df).count() == 0


def test_keep_one_keeps_columns(spark):
    rows = [(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (1, "a b c d", "y", 2), (9, "other words entirely here", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9]


def check_similar(spark, rows):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    alike = lambda a, b: a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    want = sorted((i, rows[x][0]) for (i, _), x in zip(rows, label, strict=True))
    assert len(set(label)) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id, r.component_id) for r in simhash.similar_classes(df, "doc_id", "text").collect())
    assert got == want


def test_similar_against_brute_force(spark):
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    line = some(40)
    texts = [some(rng.randrange(1, 200)) for _ in range(40)] + [some(60) + line for _ in range(30)]
    for _ in range(60):
        near = rng.choice(texts).copy()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(near))
            near[at : at + rng.randrange(2)] = some(rng.randrange(3))
        texts.append(near)
    check_similar(spark, [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0][0].upper())])


def test_near_copies_of_one_text_against_brute_force(spark):
    rng = random.Random(4)
    for length, edits, words in ((100, 5, 5), (100, 4, 1000), (60, 3, 2)):
        base, texts = [f"b{k}" for k in range(length)], []
        for _ in range(150):
            near = base.copy()
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(near))
                near[at : at + rng.randrange(3)] = [f"e{rng.randrange(words)}" for _ in range(rng.randrange(3))]
            texts.append(near)
        check_similar(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])


def test_null_and_repeated_ids_keep_other_texts(spark):
    texts = ["one two three four five six", "quite other words stand in here", "and a third text of its own", "the fourth is not like them"]
    rows = list(zip([None, None, 7, 7], texts, strict=True)) + [(None, texts[0]), (7, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        assert sorted(r.text for r in keep(df).collect()) == sorted(texts)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 60, 255, 256, 257, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0, 1, n // 10, n // 4):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed // 2).astype(np.uint64)]))
            x, y = sorted((simhash.parities(a), simhash.parities(b)), key=len)
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b)) <= 1.3 * differ + 8


def test_near_prints_are_paired(spark):
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(9000)}" for _ in range(4000)] for _ in range(4)]
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in (*texts, [*texts[0], "end"], [*texts[1], "end"])]
    fps = [simhash.simhash(np.array(sorted(s), np.uint64)) for s in sets]
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)] + [(9, simhash._signed(fps[2]))], "node long, fp long")
    assert sorted((r.a, r.b) for r in simhash._print_pairs(nodes, 2).collect()) == [(0, 4), (1, 5), (2, 9)]


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    rng = random.Random(4)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in range(300):
        near = base.copy()
        for at in rng.sample(range(5, 150, 7), rng.choice((1, 4, 4, 4))):
            near[at] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(near)))
    made, whole = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: made.setdefault(name, []).append(t := whole(df, name)) or t)
    monkeypatch.setattr(simhash, "drop_table", lambda df: None)
    check = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.similar_classes(check, "doc_id", "text").count() == 300
    assert sum(t.count() for t in made["pairs"]) < 2500
