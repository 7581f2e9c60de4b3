import pytest
from pyspark.sql import functions as F

from spanlab.llm.common import share_package

LONG = "Word after word, 12 times over. " * 4000


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    share_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose
    names the operators use themselves."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\n "), (6, LONG), (7, LONG + "end"),
            (None, base), (None, None), (8, "12345 !!"), (9, base.upper()), (10, "a\n" * 50 + base)]
    return (spark.createDataFrame(rows, "doc_id long, text string")
            .withColumn("lang", F.when(F.col("doc_id") != 4, "en")).withColumn("source", F.lit(None).cast("string"))
            .withColumn("n_chars", F.length("text").cast("long"))
            .select("*", *[F.lit(0).alias(c) for c in (
                "k", "k1", "k2", "fp", "h", "row", "gone", "key", "block", "component", "score")]))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
