import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use inside
    + [T.StructField(c, T.StringType()) for c in ("key", "hash", "node", "bucket", "gumbel_key", "notes", "body", "block", "rank", "component_id", "held_out", "f0")]
)
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (5, "word"), (None, "no id here at all"), (None, None), (6, LONG), (7, LONG), (8, "a" * 5000), (9, "é𠀀 ñandú 中文 \x00 tail"), (10, "x"), (10, "another text of the same id, longer than the other one by far")]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(i, t, None, "s", None, *("junk",) * 12) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return EDGES
