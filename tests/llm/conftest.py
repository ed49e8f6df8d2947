"""Small tables with the awkward rows that every operator has to stand."""

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
LONG = " ".join(f"word{i} and some more of it" for i in range(4000))


def documents(spark, rows, extra=()):
    """Rows (doc_id, text); ``extra`` adds columns whose names clash with those that operators use."""
    made = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCUMENT)
    for name in extra:
        made = made.withColumn(name, made["text"])
    return made


CLASHING = ("_id", "_key", "_text", "key", "term", "value", "text_", "host", "ids", "score", "rank", "position", "_fp", "kind")


@pytest.fixture()
def odd_rows():
    return [(1, "plain text of a few words"), (1, "plain text of a few words"), (1, "another text under one id"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, LONG), (5, "\x00\x1f  \u3000 é")]


@pytest.fixture()
def empty(spark):
    return documents(spark, [])
