"""Quality rules: lines are judged first, then the document by what its lines lost."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40

# Phrases that mark a line as site boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "subscribe to our newsletter",
    "licensed under",
    "click here to",
    "powered by",
)
TERMINAL = ".!?…\"'”’»:;)]。！？।॥؟۔"
NAV_MARKS = "|»›•"
SYMBOLS = b"#*$%&|<>"
SHOUT_WORDS = 5

_ascii_lower = re.compile("[a-z]")
_ascii_upper = re.compile("[A-Z]")
_space = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")
FIELDS = pa.struct(
    [(n, pa.int64()) for n in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean", pa.string())]
)
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in COUNTS]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField("clean", T.StringType())]
)


def phrases_in(text: str) -> list[str]:
    low = text.lower()
    return [p for p in BOILERPLATE if p in low]


def line_fails(line: str, phrases: list[str]) -> bool:
    """Rules for one line that has a word: boilerplate phrase, menu, symbols, shouting, no closing punctuation.

    phrases: those of BOILERPLATE that the whole text holds, so that most lines need no search.
    """
    if phrases and any(p in line.lower() for p in phrases):
        return True
    if line.rstrip(_space)[-1] not in TERMINAL:
        return True
    if sum(map(line.count, NAV_MARKS)) >= 3:
        return True
    raw = line.encode()
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if n_symbols and 2 * n_symbols > len(raw.split()):
        return True
    return not _ascii_lower.search(line) and bool(_ascii_upper.search(line)) and len(raw.split()) >= SHOUT_WORDS


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    v = len(seen)
    if v == n:
        return 0
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * v + ids[2:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    found = np.zeros(n - 2, bool)
    found[1:] = same
    found[:-1] |= same
    window = np.empty(n - 2, bool)
    window[order] = found
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= window
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """All figures of one text; a null text is judged as empty. Order as in SCHEMA."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = lost = total = 0
    clean = []
    phrases = phrases_in(text)
    for line in text.split("\n"):
        bare = line.strip(_space)
        if not bare:
            clean.append(line)
            continue
        total += len(bare)
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, phrases):
            lost += len(bare)
        else:
            clean.append(line)
    n_repeat = repeat_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * total
    return n_words, word_chars, n_symbols, dup, n_repeat, lost, base_failed, kept, "\n".join(clean)


@F.arrow_udf(SCHEMA)
def _judged(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(judge(t.as_py()) for t in texts), strict=True)) or [[]] * len(FIELDS)
    return pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], fields=list(FIELDS)
    )


def quality(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """docs with one more struct column (SCHEMA): the figures, the verdict and the cleaned text.

    A null or empty text has no words and fails the base rules; repeated rows get equal
    verdicts; an empty table stays empty; every column of docs is kept, and one called ``into`` (in any case) is an error.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"column '{into}' exists")
    return docs.withColumn(into, _judged.asNondeterministic()(F.col(f"`{text_col}`").cast("string")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = (*COUNTS, "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


_quoted = ", ".join("'" + p + "'" for p in BOILERPLATE)
_edge = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_terminal = TERMINAL.replace("'", "''")
_words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_words.format("t")} AS words FROM d),
l AS (
  SELECT doc_id, line, count(*) AS n, length(trim(line, {_edge})) AS chars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {_edge}) <> '' GROUP BY doc_id, line
),
j AS (
  SELECT *, len(list_filter([{_quoted}], lambda p: contains(lower(line), p))) > 0
    OR NOT contains('{_terminal}', right(rtrim(line, {_edge}), 1))
    OR length(line) - length(regexp_replace(line, '[{NAV_MARKS}]', '', 'g')) >= 3
    OR 2 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > len({_words.format("line")})
    OR (NOT regexp_matches(line, '[a-z]') AND regexp_matches(line, '[A-Z]') AND len({_words.format("line")}) >= {SHOUT_WORDS}) AS fails
  FROM l
),
s AS (SELECT doc_id, sum(n - 1) AS dup, sum(CASE WHEN fails THEN n ELSE n - 1 END * chars) AS lost, sum(n * chars) AS total FROM j GROUP BY doc_id),
p AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
x AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM x WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
q AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(total, 0) AS total
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * total AS kept
FROM q
"""
