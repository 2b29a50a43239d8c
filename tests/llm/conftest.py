import pytest
from pyspark.sql import types as T

from postmatch.session import local_session

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts or (id, text) pairs; further columns with clashing names on demand."""

    def make(texts, clash=False):
        rows = [(t[0], t[1], "en", "s0", len(t[1] or "")) if isinstance(t, tuple) else (i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, T._parse_datatype_string(DOCUMENTS))
        if clash:
            for name in ("t", "n", "a", "s", "f", "root", "_k", "_t", "tok", "w", "_w", "_h", "score", "shard", "bits", "begin", "html", "list"):
                df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make
