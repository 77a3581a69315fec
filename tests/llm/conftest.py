import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """(id, text) or (id, text, source) tuples -> a documents table, over several partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


CLASHING = ["fp", "u", "v", "root", "row", "key", "size", "n", "word", "start", "score", "doc", "line", "taken", "file",
            "at", "copy", "_metadata"]


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("x") for c in CLASHING})
    return add
