import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import prose, table  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    same = prose(1, 60)
    rows = [
        (1, same, "a"),
        (1, same, "a"),  # a repeated row
        (2, same, "b"),
        (3, same.replace(" ", "  ").upper(), "b"),
        (3, prose(2, 50), None),  # an id used twice
        (4, None, "a"),
        (5, "", None),
        (6, "   ", "c"),
        (7, "one", "c"),
        (None, prose(3, 40), "a"),
        (None, None, None),
        (8, prose(4, 30_000), "a"),  # very long
        (9, "x" * 60_000, "b"),
        (10, "é ü 漢字 🙂 " * 20, "a"),
        (11, "\n".join(prose(50 + i, 12) for i in range(8)), "b"),
        (12, prose(90, 12) + "\n" + "\n".join(prose(50 + i, 12) for i in range(8)), "b"),
    ]
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return awkward.where(F.lit(False))
