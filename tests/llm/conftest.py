"""Small tables with every awkward case: nulls, empties, ties, repeats, long texts, extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, found int, `row` string"


def awkward_rows() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    base = " ".join(word() for _ in range(200))
    texts += [base, base, base.replace(" ", "  "), base[:-30] + " changed end", base + "\n" + texts[3], "", "", None, None, "!!! 123", "x", "é" * 70, "日本語 text <|endoftext|> end", " ".join(word() for _ in range(30_000))]
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "t", i, "r") for i, t in enumerate(texts)]
    rows += [rows[0], rows[40], (3, "another text of id 3 that is long enough to have fifty bytes in it, surely", "a", "s0", 0, "t", 1, "r"), (None, base, "a", "s1", 0, "t", 1, "r"), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()
