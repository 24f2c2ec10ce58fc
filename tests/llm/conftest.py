from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rnd: random.Random, words: int, syllables=("ta", "ren", "lo", "mi", "sko", "ü", "ver", "a", "né")) -> str:
    out = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    return " ".join(out).capitalize() + "."


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    """Plain texts, lines, copies, near copies, a shared passage, secrets, odd white space, empty, null and long texts."""
    rnd = random.Random(seed)
    rows = []
    shared = sentence(rnd, 60)
    base = sentence(rnd, 130)
    for i in range(n):
        text = "\n".join(sentence(rnd, rnd.randint(3, 25)) for _ in range(rnd.randint(1, 6)))
        if i % 7 == 1:
            text = shared + "\n" + text
        if i % 5 == 2:
            words = base.split(" ")
            words[rnd.randrange(len(words))] = "other"
            text = " ".join(words)
        if i % 11 == 3:
            text += f' password = "{"Ab3" * rnd.randint(1, 6)}" AKIA{"Q7" * rnd.randint(6, 12)} ' + "0af9" * rnd.randint(4, 9)
        rows.append((i * 3, text, ("xx", "yy", None)[i % 3], ("src2", "src1", "src10", "Ä", None)[min(i % 9, 4)], len(text)))
    odd = [None, "", " \n\t ", "one", "two words", "a  b　 c", "tokens <|endoftext|> in <|startoftext|>text", "X" * 3000,
           "\n".join(sentence(rnd, 9) for _ in range(900)), rows[4][1], rows[4][1].upper(), "ﬁ É é İ ΑΣ 漢字 ½ 12345 !?!"]
    rows += [(1000 + k, t, None, "src1", None) for k, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Repeated rows, rows without a doc_id, and further columns whose names an operator might use itself."""
    more = [*rows[:12], rows[0], rows[0], (None, "no id at all", "xx", "src1", 3), (rows[1][0], "another text under a known id", None, None, 1)]
    names = ("row", "key", "n", "size", "rank", "h", "fold", "_block", "bucket", "spans", "gid", "sid", "t", "k", "words", "id", "_id")
    return spark.createDataFrame(more, SCHEMA).withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clean(rows):
    """(doc_id, text) of rows with an id, null texts empty."""
    return [(r[0], r[1] or "") for r in rows if r[0] is not None]


def collected(df):
    return [r.asDict() for r in df.collect()]
