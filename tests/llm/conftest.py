import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_documents(spark):
    def make(rows, **extra):
        """Rows of (doc_id, text) as a documents table, with columns whose names the operators use inside."""
        from pactlens.llm.common import reach_package

        reach_package(spark)
        frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCUMENTS)
        for name, value in extra.items():
            frame = frame.withColumn(name, F.lit(value))
        return frame

    return make


@pytest.fixture(scope="session")
def corpus(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
