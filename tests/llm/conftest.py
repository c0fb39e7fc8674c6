import pytest


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and repeated rows, one long line, clashing extra columns."""
    long_line = " ".join(f"w{i % 900}x{i}" for i in range(6000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "xx", "a"), (4, "One two", "en", "a"), (4, "One two", "en", "a"),
            (None, "one  two", "de", None), (5, long_line, "en", "b"), (6, long_line + " tail", "en", "b"), (7, "a\n" * 50, "en", "c"),
            (8, "Mail a@b.org or +1 (555) 123-4567 from 10.0.0.1. Released under the MIT License.\nReleased under the MIT license", "en", "c")]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                                 "doc_id long, text string, lang string, source string, node int, shard int, size int")
