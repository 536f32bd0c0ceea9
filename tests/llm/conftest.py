import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1),
    (2, "one two three four five six seven", "en", "a", 1),
    (2, "one two three four five six seven", "en", "a", 1),
    (3, "onetwo three four five  six\nseven", "en", None, None),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n", None, "b", 3),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG + " end", "en", "c", len(LONG)),
    (None, "no id here at all", None, "a", 2),
    (9, "é ü ß 12 34 <|endoftext|>", "de", "é", 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
