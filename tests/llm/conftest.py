from __future__ import annotations

import pytest
from plain import SCHEMA, document, prose


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([r if len(r) == len(SCHEMA) else document(*r) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, one very long text and word, ties and repeated rows."""
    long = prose(1, 60_000)
    return [(None, prose(2, 80)), (None, None), (1, None), (2, ""), (3, " \t\n\x0b "), (4, prose(3, 90)), (4, prose(3, 90)), (5, prose(3, 90)), (6, "w" * 300_000), (7, long, None, None), (8, "éèü " * 70), (9, "one two"), (10, "One TWO"), (11, prose(4, 100), "fr", "b"), (12, "\n".join([prose(5, 12)] * 8))]
