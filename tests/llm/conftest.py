import os

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, sig long, rid string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

_BASE = "the quick brown fox jumps over the lazy dog and runs through the green field to find " * 3


def _rows():
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows and repeated ids."""
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(40)) + " "
    passage = "This very passage of more than one hundred bytes stands in several documents, word for word, and must go. "
    texts = {
        1: own(1) + passage + own(101),
        2: own(2) + passage,
        3: passage + own(3),
        4: own(4) + own(104) + own(204),
        5: own(4) + own(104) + own(204) + "end",
        6: own(4) + own(104) + own(204),
        7: "",
        8: " \t\n\x0b\x0c\r ",
        9: None,
        10: "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0 gnu",
        11: "a a a a a a a a a a a a a a a a a a a a a a a a",
        12: "Ünïcödé ÄÖÜ straße 日本語 \U0001f642 <|endoftext|> don't " * 4,
        13: _BASE * 60,
        14: "one two three",
        15: "one two three",
        16: "### $$$ | %% && <> ** # $ | " * 5,
        17: "GNU general-public license\nGNU general-public license\nx\nx\n",
    }
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None, "é"][k % 4], len(t or ""), k, None, "r") for k, t in texts.items()]
    rows += [(3, texts[3], None, "a", None, 0, 0, None)] * 2  # a repeated row
    rows += [(4, "another text of the id four, with words enough to be judged by any rule of this table at all", "en", "a", 1, 1, 1, "x")]
    rows += [(None, own(9), "en", "b", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(spark):
    """The same without null and repeated ids."""
    seen, rows = set(), []
    for r in _rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
