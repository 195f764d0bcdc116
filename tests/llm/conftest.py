import pytest
from pyspark.sql import types as T

LONG = "word" + " and more of the same, said again" * 6000
ROWS = [
    (1, "The thing was on the hand and the other hand was over it.", "en", "s", 0.5, "a"),
    (2, "The thing was on the hand and the other hand was over it.", "en", "s", 0.5, "a"),
    (2, "The thing was on the hand and the other hand was over it.", "en", "s", 0.5, "a"),
    (3, None, "en", "s", None, None),
    (4, "", None, "s", 1.0, "b"),
    (5, " \t\n ", None, None, 1.0, "b"),
    (6, "12345 !!! ???", "de", "s", 1.0, "b"),
    (7, LONG, "en", "s", 1.0, "b"),
    (None, "Without a key, yet with words enough for some shingles.", "en", None, 1.0, "b"),
    (8, "naïve café 😀 mail a.b@c-d.org or +1 (802) 555-9869, token = \"abc123def\" 10.0.0.255", None, "s", 1.0, "b"),
    (9, "two words", "fr", "s", 1.0, "b"),
]
# Names that the operators use inside or add to their results.
FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.DoubleType()), ("matches", T.StringType())]
MORE = ["ids", "spans", "key", "block", "h", "d", "more", "shard", "label", "row", "_range", "held_out"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    schema = T.StructType([T.StructField(*f) for f in FIELDS] + [T.StructField(m, T.StringType()) for m in MORE])
    return spark.createDataFrame([(*r, *["x"] * len(MORE)) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
