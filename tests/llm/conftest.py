import pytest
from pyspark.sql import Row


@pytest.fixture
def odd_docs(spark):
    """Null and repeated keys, null, empty and very long texts, ties, and columns named like the operators' own."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (4, long), (5, long + " end"), (6, "çé 日本 ß"), (7, "a b c d e f g")]
    return spark.createDataFrame([Row(doc_id=k, text=t, key=9, size=0, share=1, marks="x", length=3, note=None) for k, t in rows],
                                 "doc_id long, text string, key int, size int, share int, marks string, length int, note string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
