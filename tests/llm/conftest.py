from __future__ import annotations

import random

import pytest

#: Columns whose names operators use themselves.
CLASHING = ("k", "t", "g", "c", "item", "score", "ids", "n", "o", "y", "bucket", "rate", "parts", "cumulative", "count", "copy", "d", "row", "name", "h", "fold")


def prose(rng: random.Random, words: int, stems=("an", "the", "ing", "re", "on", "er", "es", "ti")) -> str:
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """rows of (doc_id, text, lang, source) with n_chars and columns of clashing names."""
    full = [(i, t, lang, source, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, lang, source in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "src0"), (21, base[0] + " end", "en", None), (22, " ".join(base[1].split()[:119]), None, "src1")]  # a copy and near ones
    rows += [(30, None, "en", "src0"), (31, "", None, None), (32, " \n\t", "en", "src0"), (33, "one two", "fr", "src1"), (34, "12 34!", "en", "src0")]
    rows += [(40, "ж" * 3000 + " " + prose(rng, 9000), "en", "src1"), (41, "a" * 30_000, "en", "src1"), (42, "\x0b\x0c é🙂 ▁ \x00", "fr", "src0")]
    rows += [(None, "no id here", "en", "src0"), (None, None, None, None)]
    rows += [(3, base[3], "en", "src1")]  # a repeated row
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
