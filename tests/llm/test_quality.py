"""Quality rules against the SQL of the same rules and against enumeration."""

import random
from collections import Counter

import duckdb
import pandas as pd

from brindle.llm import quality


def texts():
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma,", "delta.", "é", "x#", "|", "***"]
    lines = ["Home | News | Sport | More", "ALL RIGHTS RESERVED.", "STOP IT NOW OR ELSE ALWAYS!", "no end here", "A fine line ends here.", "  ", "", "A fine line ends here.", "ok\r", "tail.\x0b"]
    out = [None, "", " \n\t", "one", "a b c a b c", "w " * 5000, "é" * 70000]
    for _ in range(150):
        pick = [rng.choice(lines) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 40))) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(1, 12))]
        out.append("\n".join(pick))
    return out


def test_sql_and_python_agree(spark):
    rows = list(enumerate(texts()))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(quality.ORACLE).fetchall())
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = quality.quality(df).select("doc_id", "quality.*", "n_words").collect()
    assert sorted(tuple(r)[:9] for r in got) == want


def test_repeat_words_by_enumeration():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 14))]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert quality.repeat_words(w) == len(covered)


def test_cleaned_text_and_verdict():
    rng = random.Random(4)
    prose = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9)) + "." for _ in range(10))
    n, *_, failed, kept, clean = quality.judge(prose + "\nHome | About | Contact | Login\nLicensed under the Apache License.")
    assert kept and not failed and clean == prose and n > 50
    assert not quality.judge("word " * 10)[-2]


def test_rows_stay(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert quality.quality(df).count() == 3 and quality.quality(df.limit(0)).count() == 0
