import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="session")
def make(spark: SparkSession, docs_schema):
    """Documents from texts (or (id, text) pairs), over a few partitions."""
    def build(texts, partitions=3):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, docs_schema).repartition(partitions)
    return build
