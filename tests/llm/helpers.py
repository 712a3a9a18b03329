import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("name", T.StringType()), T.StructField("key", T.StringType())])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    """(doc_id, text, source) rows as documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en" if t else None, s, None if t is None else len(t), "x", None, "k") for d, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    return [(1, None, None), (2, "", "a"), (3, "   \n", "a"), (None, "one two three", None), (None, None, "b"), (4, "one two three", "b"),
            (4, "one two three", "b"), (4, "other text under a used id", "c"), (5, long, "a"), (6, long + " end", "a"), (7, "\x01é\U0001f600 x", "c"),
            (8, "w" * 300_000, "a")]
