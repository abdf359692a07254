import pytest
from pyspark.sql import types as T

LONG = "alpha beta gamma delta " * 4000 + "omega"


def texts():
    """Ids and texts with nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, "Licensed under the Apache License, Version 2.0. All rights reserved."),
        (2, ""), (3, None), (4, "   \n\t "), (5, LONG), (5, LONG), (6, "one"), (7, "one two"), (8, "One TWO three"),
        (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z. The end of it is near, they said."),
        (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z. The end of it is near, they said."),
        (None, "a row without an id, but with a text of its own; it is long enough to pass the rules of length here."),
        (None, None), (10, "émile Ångström 日本語 😀 don't it's 1234 <|endoftext|> CC-BY cc by"), (11, "12345 67890 !!! ???"),
        (12, "line one is here\nline one is here\n\nline one is here\n  "),
    ]


#: Extra columns whose names the operators use themselves.
CLASH = ["score", "kept", "n_words", "row", "row_no", "bucket", "fp", "spans", "label", "rank", "length", "part", "class"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASH)])
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 1 else f"s{(i or 0) % 3}/p", len(t or ""), *CLASH)
            for i, t in texts()]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (99, 0, 1)],
        "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    def read(name, sf="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    return read
