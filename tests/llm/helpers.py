"""Small tables with the cases that every operator must stand."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix strange potions near a quiet river bank under pale moonlight and sing old songs about lost ships that never came home again until dawn broke over the hills and everyone went to sleep at last dreaming of gold and silver coins hidden deep below the roots of an ancient oak tree"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside or for their results.
        *(T.StructField(c, T.StringType()) for c in ("score", "rep", "key", "perplexity", "rejected", "ids", "found", "id", "component")),
    ]
)


def odd_rows():
    """Null, empty, blank, short, very long, repeated and non-ASCII texts."""
    texts = [None, "", "  \n\t ", "one", BASE, BASE, BASE.upper(), LONG, "Ünïcödé    日本語 😀 don't we'LL 12½", "a\x00b \x1c c", BASE + " tail"]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append((4, BASE, "en", "s", len(BASE)))  # a repeated row
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(*r, *("x",) * 9) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
