"""Language identification: bit-sliced Bloom filters give the languages of each n-gram, popcounts decide."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import table

UNKNOWN = "und"
GRAM_BYTES = 4
#: Documents of each language that are learned from, about (a share of them by a hash of the id).
TRAIN_DOCS = 2000
#: Commonest n-grams of each language that its filter holds.
LANGUAGE_GRAMS = 5000
MAX_LANGUAGES = 1024
SLOT_BITS = 18
HASHES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
CHUNK = 1 << 20
HELD_OUT_FOLD = 5

_not_letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ascii_letter = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ascii_letter.search(text) is not None or any(map(str.isalpha, text)))


def grams(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams as integers: bytes of its words in lower case, each between blanks; a piece at a time."""
    words = text.lower().encode().translate(_not_letters).split()
    data = b"  " + b" ".join(words) + b"  "
    flat = np.frombuffer(data, np.uint8)
    for at in range(0, len(flat) - GRAM_BYTES + 1, CHUNK):
        piece = flat[at : at + CHUNK + GRAM_BYTES - 1].astype(np.uint32)
        out = piece[: 1 - GRAM_BYTES].copy()
        for k in range(1, GRAM_BYTES):
            out |= piece[k : len(piece) + k - GRAM_BYTES + 1] << np.uint32(8 * k)
        yield out


def slots(found: np.ndarray) -> list[np.ndarray]:
    return [(found * h) >> np.uint32(32 - SLOT_BITS) for h in HASHES]


@dataclass
class Filters:
    """slices: by word of 64 languages, a slot's mask of languages; wrong: each filter's share of false positives."""

    languages: list[str]
    slices: list[np.ndarray]
    wrong: np.ndarray
    prior: str

    @classmethod
    def build(cls, grams_of: dict[str, list[int]], docs_of: dict[str, int]) -> Filters:
        languages = sorted(grams_of)
        slices, wrong = [], []
        for first in range(0, len(languages), 64):
            own = languages[first : first + 64]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(own) <= np.dtype(k).itemsize * 8)
            masks = np.zeros(1 << SLOT_BITS, kind)
            for bit, language in enumerate(own):
                for at in slots(np.array(grams_of[language], np.uint32)):
                    masks[at] |= kind(1 << bit)
                wrong.append(float(np.mean(masks >> kind(bit) & kind(1))) ** len(HASHES))
            slices.append(masks)
        return cls(languages, slices, np.array(wrong), max(languages, key=lambda x: (docs_of[x], x), default=UNKNOWN))

    def languages_of(self, found: np.ndarray) -> list[np.ndarray]:
        """Masks of all languages whose filter has each n-gram: one slot's mask and the others'."""
        places = slots(found)
        out = []
        for masks in self.slices:
            hit = masks[places[0]]
            for at in places[1:]:
                hit &= masks[at]
            out.append(hit)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the most n-grams, less the false positives to expect, and its share among all languages."""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        counts, n = np.zeros(len(self.languages)), 0
        for found in grams(text):
            n += len(found)
            at = 0
            for hit in self.languages_of(found):
                values = np.bincount(hit) if hit.dtype == np.uint8 else None
                for bit in range(min(64, len(self.languages) - at)):
                    if values is not None:
                        have = np.arange(len(values)) >> bit & 1
                        counts[at + bit] += int(values @ have)
                    else:
                        counts[at + bit] += int(np.count_nonzero(hit >> hit.dtype.type(bit) & hit.dtype.type(1)))
                at += 64
        right = np.maximum((counts - n * self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0)
        total = right.sum()
        if total <= 0:
            return self.prior, 0.0
        best = int(np.argmax(right))
        return self.languages[best], float(right[best] / total)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(language, []).extend(grams(text.as_py()))
        for language, found in by.items():
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"language": pa.array([language] * len(values), pa.string()), "gram": values.astype(np.int64), "n": counts}
            )


def learn(labelled: DataFrame, id_col: str, text_col: str, language_col: str, *, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from labelled rows: about train_docs of each language, chosen by a hash of the id, whole texts.

    Rows without id, text or language are left out. What reaches the driver is bounded by
    MAX_LANGUAGES and LANGUAGE_GRAMS.
    """
    rows = labelled.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{language_col}`").cast("string").alias("language")
    ).where("id is not null and text is not null and language is not null")
    docs_of = {r.language: r.n for r in rows.groupBy("language").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(docs_of) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not docs_of:
        return Filters([], [], np.empty(0), UNKNOWN)
    share = F.create_map(*[x for k, n in docs_of.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    luck = F.xxhash64(F.lit(5), "id").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    sample = rows.where(luck <= F.try_element_at(share, F.col("language"))).select("language", "text")
    counted = sample.mapInArrow(_counted, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= LANGUAGE_GRAMS)
    grams_of: dict[str, list[int]] = {k: [] for k in docs_of}
    for r in top.select("language", "gram").collect():
        grams_of[r.language].append(r.gram)
    return Filters.build(grams_of, docs_of)


ANSWER = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, filters: Filters, text_col: str, into: str = "lang_id") -> DataFrame:
    """docs with one more struct column: language and score (0 to 1) of each whole text.

    ``und`` for a null text or one without letters; a text none of whose n-grams is known gets the
    commonest language and score 0. Of languages with equal counts the first by name is taken. All rows and columns
    stay; a column called ``into`` (in any case) is an error.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"column '{into}' exists")

    @F.arrow_udf(ANSWER)
    def of(texts: pa.Array) -> pa.Array:
        found = [filters.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["language", "score"]
        )

    return docs.withColumn(into, of.asNondeterministic()(F.col(f"`{text_col}`").cast("string")))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_FOLD == 0, F.lit(False))
    filters = learn(docs.where(~held_out), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), filters, "text")
    return found.select("doc_id", "held_out", F.col("lang_id.language").alias("lang_pred"), F.col("lang_id.score").alias("score"))
