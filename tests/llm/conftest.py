import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs or full rows."""
    def make(rows, schema=SCHEMA):
        full = [r if len(r) > 2 else (*r, "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture
def extra():
    """The same documents with more columns, named like results of the operators."""
    from pyspark.sql import functions as F

    names = ["score", "piece", "length", "offset", "ids", "shard", "slot", "class_id", "members", "key", "kept", "n_words", "media", "facts"]

    def add(df):
        return df.withColumns({n: F.lit("clash") for n in names})
    return add


