"""Packing: an exact round trip of all ids, and differencing's bounds."""

import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from brindle.llm import packing


def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "don't I'll THE 'S x'y''s", "a1b22c.,!? <|endoftext|> x", "日本語 naïve café é", "x\x1cy\xa0z\x85q ªº µ x²½"]
    out += ["word " * 5000, "y" * 9000]
    return out + [" ".join(rng.choices(["alpha", "Beta,", "gamma.", "Ünd", "7"], k=rng.randrange(1, 900))) for _ in range(60)]


@pytest.mark.parametrize("window", [2048, 64])
def test_round_trip(spark, window):
    rows = list(enumerate(texts())) + [(3, texts()[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(2)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, "doc_id", "text", packing.tokenizer_path(), window=window).collect():
        ids = list(struct.unpack(f"<{r.length}I", r.ids))
        assert zlib.crc32(r.ids) == r.ids_crc32 and r.length > 0
        assert any(len(w) == r.doc_tokens and w[r.start : r.start + r.length] == ids for w in want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for i, copies in want.items():
        at = [0] * len(copies)
        for start, length in sorted(documents[i]):
            at[at.index(start)] += length
        assert at == [len(w) for w in copies]
    total = sum(len(w) for v in want.values() for w in v)
    assert len(sequences) * window <= 1.1 * total + 4 * window


def test_difference_is_even():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 500) for _ in range(400)]
    found, most = packing.difference(sizes, 40)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(400))
    assert most == max(sums) and max(sums) - min(sums) <= 20


def test_count_rises_over_capacity():
    found = packing.windows_of([60, 60, 60], 100)
    assert sorted(map(len, found)) == [1, 1, 1]
    assert packing.windows_of([], 100) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, "doc_id", "text", packing.tokenizer_path()).count() == 0
