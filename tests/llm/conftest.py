import pytest
from pyspark.sql import SparkSession

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark: SparkSession):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(rows, **more):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make
