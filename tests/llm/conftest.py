import re

import pytest

from ..conftest import duck, spark  # noqa: F401

SF = "/root/testdata/sf0.001"
ALNUM = r"[a-z0-9\x80-\U0010ffff]+"
EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, score double, word string, path string, "
               "n_links int, removed string, ids string, n_words int, p double, token long, a long")
LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(60_000))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(ALNUM, lower(t))


@pytest.fixture(scope="session")
def edges(spark):  # noqa: F811
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing names."""
    extra = (0.5, "w", "p", 3, "r", "i", 7, 0.25, 9, 1)
    rows = [
        (1, "A first line with seven words here.\nsecond short", "en", "s", 5),
        (1, "A first line with seven words here.\nsecond short", "en", "s", 5),
        (2, None, "en", None, None),
        (3, "", None, "s", 0),
        (4, " \n\t\n ", "de", "s", 5),
        (None, "A first line with seven words here.\nnull id", "en", "s", 5),
        (5, LONG, "en", "s", 5),
        (6, "!!! ... ###", "fr", "s", 5),
        (7, "a first LINE with seven words here\nélan vital übrig", "de", "s", 5),
        (7, "another text under the same id, of some words", "de", "s", 5),
        (8, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows] + [(9, "no extras at all", *[None] * 13)], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")
