"""The pipeline's stages over a fixture: what each keeps, and an exact round trip of the last."""

import random
import struct
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import packing
from brindle.llm.quality import judge


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8)))
    some = lambda n: [word() for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 12]) + "." for i in range(0, len(w), 12))
    passage = some(120)
    rows = [(i, lines(some(rng.randrange(60, 300)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1])]
    rows += [(110, lines(some(96) + passage + some(96))), (111, lines(some(60) + passage + some(120)))]
    rows += [(120, "menu | home | about | us\n" * 40), (121, None), (122, ""), (123, rows[7][1] + "\nAll rights reserved.")]
    path = tmp_path_factory.mktemp("corpus")
    data = [(i, t, "en", rng.choice(["a", "b", None]), None, "x") for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path), data


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        yield name, docs


def test_stages(spark, folder):
    path, data = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars", "quality"]
    out = dict(stages(spark, path))
    assert all(out[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])
    rows = {name: df.collect() for name, df in out.items()}
    judged = [(d[0], judge(d[1])) for d in data]
    kept = sorted((i, j[-1]) for i, j in judged if j[-2])
    assert sorted((r.doc_id, r.text) for r in rows["quality_rules"]) == kept
    assert {120, 121, 122}.isdisjoint(i for i, _ in kept) and dict(kept)[123] == data[7][1]
    near = sorted(r.doc_id for r in rows["simhash_dedup"])
    assert near == sorted({i for i, _ in kept} - {100, 101, 123})
    cut = {r.doc_id: r for r in rows["substring_dedup"]}
    assert sorted(cut) == near and all(r.n_chars == len(r.text) for r in cut.values())
    whole = dict(kept)
    changed = [i for i in near if cut[i].text != whole[i]]
    assert len(changed) == 1 and changed[0] in (110, 111)
    taken = defaultdict(int)
    for r in rows["source_mixing"]:
        assert r.text == cut[r.doc_id].text
        taken[r.doc_id] += 1
    assert max(taken.values()) <= 2
    words = sum(len(cut[i].text.split()) * n for i, n in taken.items())
    assert abs(words - 1.5 * sum(len(r.text.split()) for r in cut.values())) <= 150
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = defaultdict(list)
    for r in rows["packing"]:
        assert struct.unpack(f"<{r.length}I", r.ids) == tuple([*tokenizer.encode(cut[r.doc_id].text, add_special_tokens=False).ids, 1][r.start : r.start + r.length])
        pieces[r.doc_id].append(r.length)
    assert {i: sum(v) for i, v in pieces.items()} == {i: n * next(r.doc_tokens for r in rows["packing"] if r.doc_id == i) for i, n in taken.items()}


def test_run_and_empty_table(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    changed, longer = base.copy(), base.copy()
    changed[40], changed[90] = "other", "words"
    longer.insert(60, "inserted")
    far = base[:60] + [f"v{rng.randrange(5000)}" for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, changed, longer, far])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [0, 3]
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), "").count() == 0
