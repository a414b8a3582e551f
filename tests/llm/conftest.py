import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from llmdata import BASE, CLASH  # noqa: E402

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977} the of" for i in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree near the river bank"
    rows = [
        (1, prose, "en", "a", 10),
        (1, prose, "en", "a", 10),
        (2, prose, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "fr", "b", 0),
        (5, long, "en", "a", 1),
        (None, prose + " again", "en", "b", 5),
        (6, "!!! ... 123 456", "de", "b", 3),
        (7, "один два три четыре пять шесть", "ru", "c", 3),
        (8, "\n\n \t", None, "c", 3),
        (None, None, None, None, None),
    ]
    extra = ("x", None, "y", 7, None, "z", 3, "s", 1, "n")
    return spark.createDataFrame([r + extra for r in rows], f"{BASE}, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{BASE}, {CLASH}")
