import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    """The contract's words, plainly."""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a clashing column."""
    rows = [
        (1, "Licensed under CC BY-NC 4.0. " + "alpha beta gamma delta epsilon zeta " * 3, "en", "a", 5, "x"),
        (1, "Licensed under CC BY-NC 4.0. " + "alpha beta gamma delta epsilon zeta " * 3, "en", "a", 5, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, "y"),
        (None, "one two three four five six seven", "en", None, None, "z"),
        (4, "word " * 60_000, "de", "b", 1, "x"),
        (5, "x" * 400_000, "de", "b", 1, "x"),
        (6, "### $$$ 123", None, "b", 1, "x"),
        (7, "Élan über ñandú", "fr", "c", 1, "x"),
        (1, "another text under the same id", "en", "a", 5, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Spans string"
    return spark.createDataFrame(rows, schema)
