"""Reply context: the parents of each message, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def reply_context(rows: DataFrame, history: DataFrame, id_col: str = "telegram_id", parent_col: str = "reply_to_id", text: str = "text", extra: tuple[str, ...] = (), seq: str = "ingest_seq", depth: int = P.CONTEXT_DEPTH) -> DataFrame:
    """Adds ``reply_context``: array of struct id, text and extra columns, at most depth long.

    A missing parent ends the chain, and so does one that was met before (the
    row itself isn't among those met).  Of rows that share an id the last counts.
    Each step is an equi-join on the id; popular parents are left to AQE's skew
    handling since no aggregation follows.
    """
    kept = F.struct(F.col(parent_col).alias("__up"), X.strip(F.left(X.strip(X.or_empty(F.col(text))), F.lit(P.CONTEXT_CHARS))).alias("text"), *extra)
    known = history.where(F.col(id_col) > 0).groupBy(F.col(id_col).alias("__id")).agg(F.max_by(kept, seq).alias("__row")).select("__id", "__row.*")
    item = F.struct(F.col("__id").alias(id_col), "text", *extra)
    out = rows.withColumn("__next", F.coalesce(F.when(F.col(parent_col) != 0, F.col(parent_col)), F.lit(None)))
    out = out.withColumn("__met", F.array().cast("array<bigint>"))
    for step in range(depth):
        found = known.select(F.col("__id"), item.alias(f"__c{step}"), F.col("__up").alias(f"__u{step}"))
        out = out.join(found, F.col("__next") == F.col("__id"), "left").drop("__id")
        met = F.when(F.col(f"__c{step}").isNotNull(), F.concat("__met", F.array(F.col("__next").cast("bigint")))).otherwise(F.col("__met"))
        out = out.withColumn("__met", met)
        up = F.col(f"__u{step}")
        out = out.withColumn("__next", F.when((up != 0) & ~F.array_contains("__met", up.cast("bigint")), up))
    chain = F.reverse(F.array_compact(F.array(*[F.col(f"__c{k}") for k in range(depth)])))
    return out.select(*rows.columns, chain.alias("reply_context"))
