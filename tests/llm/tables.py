"""Tables with all that an operator must put up with."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], SCHEMA)


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, a null key."""
    rows = [
        (1, "The cat sat on the mat and it was very happy there."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 30_000),
        (7, "The cat sat on the mat and it was very happy there."), (7, "The cat sat on the mat and it was very happy there."), (None, "A row without a key, mail me at a.b@c.example."), (8, "日本語 😀 é\u0000 ok"),
    ]
    df = documents(spark, rows)
    return df.unionByName(spark.createDataFrame([(9, None, None, None, None)], SCHEMA))


def clashing(df):
    """The same with columns that are named like those that operators make."""
    names = ["id", "fp", "ids", "decoded", "n_tokens", "kind", "row", "rep", "base", "every", "found", "spans", "key", "w", "p", "component_id", "label", "held_out", "score", "item_id", "cand", "node"]
    return df.withColumns({n: F.lit("clash") for n in names})


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
