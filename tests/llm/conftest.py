"""Small tables with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(("an", "the", "re", "on", "ti", "er")) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    passage = sentence(rng, 60)
    made = [(i, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), i) for i in range(60)]
    made += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "a", 3), (103, "é" * 7, "fr", "b", 7)]
    made += [(110 + i, passage, "en", "a", 1) for i in range(5)]
    made += [(120 + i, f"{sentence(rng, 9)} {passage} {sentence(rng, 9)}", "en", "hot", 1) for i in range(5)]
    made += [(130, "ab" * 3000, "en", "a", 6000), (131, sentence(rng, 20000), "en", "a", 1), (132, "x" * 9000, None, "b", 9000)]
    made += [made[3], made[3]]
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def unique_docs(spark, rows):
    return spark.createDataFrame(list({r[0]: r for r in rows}.values()), DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
