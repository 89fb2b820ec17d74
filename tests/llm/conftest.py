import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from words import prose  # noqa: E402


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]), with extra columns whose names operators might use themselves."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, rank int, bucket int, label string, id long, row int"
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, 1, "y", 7, 3) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return make([(1, None), (2, ""), (3, "one two"), (4, prose(4, 80)), (4, prose(4, 80)), (5, prose(4, 80)), (6, long), (None, prose(9, 40)), (None, None), (7, "a\n\nb\na")])
