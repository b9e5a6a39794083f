import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) pairs as a documents table."""
    return lambda *rows: spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOC)


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empties, ties, repeats, a long text, control characters."""
    base = " ".join(f"word{i}" for i in range(60))
    return [(1, base), (1, base), (2, None), (3, ""), (None, base), (None, None), (4, "x" * 250_000), (5, "a b c " * 3000), (6, base + " tail"), (7, "é" * 120 + "\x00\x1c mixed"), (6, "other text with the same id"), (-3, "\n\n \t"), (8, base)]


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory):
    """Write DataFrames as a tables folder: name -> DataFrame."""

    def write(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(str(root / f"{name}.parquet"))
        return str(root)

    return write
