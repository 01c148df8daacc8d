"""Language identification: filters against sets, held-out accuracy, odd inputs."""

import random

import numpy as np

from brindle.llm import langid

WORDS = {
    "aa": "the of and with from house river stone water thing other".split(),
    "bb": "der die und mit von haus fluß stein wasser sache andere".split(),
    "cc": "дом река камень вода вещь другой это и на под".split(),
}


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[k], k=20)) + ".", k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_filters_hold_all_grams_and_few_others():
    rng = np.random.default_rng(1)
    own = {k: rng.integers(0, 2**32, 3000, dtype=np.uint32) for k in ("a", "b", *(f"l{i}" for i in range(70)))}
    filters = langid.Filters.build({k: v.tolist() for k, v in own.items()}, dict.fromkeys(own, 1))
    names = filters.languages
    for k in ("a", "b", "l9"):
        at = names.index(k)
        assert (filters.languages_of(own[k])[at // 64] >> np.uint64(at % 64) & np.uint64(1)).all()
    strange = rng.integers(0, 2**32, 200_000, dtype=np.uint32)
    at = names.index("b")
    share = np.mean(filters.languages_of(strange)[at // 64] >> np.uint64(at % 64) & np.uint64(1))
    assert abs(share - filters.wrong[at]) < 1e-3


def test_held_out_accuracy(spark):
    df = spark.createDataFrame([(*r, 0.5) for r in corpus()], "doc_id long, text string, lang string, score double")
    filters = langid.learn(df.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    got = langid.identify(df.where("doc_id % 5 = 0"), filters, "text").collect()
    assert len(got) == 24 and all(r.lang_id.language == r.lang and 0 <= r.lang_id.score <= 1 for r in got)


def test_odd_texts(spark):
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "zzzzqqqq"), (5, "Haus " * 300_000), (5, "Haus"), (6, "ß")]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    train = spark.createDataFrame(corpus() + [(None, "x", "aa"), (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    filters = langid.learn(train, "doc_id", "text", "lang")
    got = [(r.doc_id, r.lang_id.language) for r in langid.identify(df, filters, "text").collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3][1] in WORDS and got[4:] == [(5, "bb"), (5, "bb"), (6, "bb")]
    empty = langid.learn(train.limit(0), "doc_id", "text", "lang")
    assert {r.lang_id.language for r in langid.identify(df, empty, "text").collect()} == {"und"}
    assert langid.identify(df.limit(0), filters, "text").count() == 0


def test_ties_take_the_first_name():
    texts = [" ".join("abcdefgh"[i % 8] * 3 for i in range(j, j + 9)) for j in range(5)]
    own = [int(g) for t in texts for found in langid.grams(t) for g in found]
    for names in ("xy", "yx"):
        filters = langid.Filters.build({k: own for k in names}, dict.fromkeys(names, 1))
        assert filters.languages == ["x", "y"] and all(filters.predict(t)[0] == "x" for t in texts)


def test_predictions_against_plain_sets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df, "doc_id", "text", "lang")
    # All documents are learned from, so that the sets are known: the commonest grams of each language, ties by value.
    seen = {k: {} for k in WORDS}
    for _, text, lang in rows:
        for found in langid.grams(text):
            for g in found.tolist():
                seen[lang][g] = seen[lang].get(g, 0) + 1
    sets = {k: set(sorted(v, key=lambda g: (-v[g], g))[: langid.LANGUAGE_GRAMS]) for k, v in seen.items()}
    for _, text in [(i, t) for i, t, _ in corpus(60, 9)]:
        counts = {k: sum(g in s for found in langid.grams(text) for g in found.tolist()) for k, s in sets.items()}
        assert filters.predict(text)[0] == max(sorted(counts), key=counts.get)
