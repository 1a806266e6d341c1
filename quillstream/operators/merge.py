"""Keyed merges of logs and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(row: Column) -> Column:
    """A row as JSON text, nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def _filled(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return F.coalesce((c != "").cast("int"), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce((F.size(c) > 0).cast("int"), F.lit(0))
    return c.isNotNull().cast("int")


def row_score(df: DataFrame, version: str = "editorial_version", leave: tuple[str, ...] = ("ingest_seq",)) -> Column:
    """struct: version, filled fields, length of the JSON text; the larger row is the better one.

    Null, empty text and empty arrays aren't filled; 0 and false are.
    """
    fields = [f for f in df.schema.fields if f.name not in leave]
    v = F.coalesce(F.col(version).cast("long"), F.lit(0)) if version in df.columns else F.lit(0).cast("long")
    filled = sum((_filled(f.name, f.dataType) for f in fields), F.lit(0))
    return F.struct(v.alias("version"), filled.alias("filled"), F.length(_text(F.struct(*[f.name for f in fields]))).alias("size"))


def id_key(df: DataFrame, id_col: str = "telegram_id", leave: tuple[str, ...] = ("ingest_seq",)) -> Column:
    """The id if it is positive, else the whole row."""
    rest = F.struct(*[c for c in df.columns if c not in leave])
    return F.when(F.col(id_col) > 0, F.concat(F.lit("id:"), F.col(id_col).cast("string"))).otherwise(F.concat(F.lit("raw:"), _text(rest)))


def event_key(df: DataFrame, event_col: str = "event", id_col: str = "telegram_id", leave: tuple[str, ...] = ("ingest_seq",)) -> Column:
    """Event and id if both are set, else the whole row."""
    rest = F.struct(*[c for c in df.columns if c not in leave])
    both = (F.coalesce(F.col(event_col), F.lit("")) != "") & (F.col(id_col) > 0)
    return F.when(both, F.concat(F.lit("event:"), F.col(event_col), F.lit(":"), F.col(id_col).cast("string"))).otherwise(F.concat(F.lit("raw:"), _text(rest)))


def merge_logs(remote: DataFrame, local: DataFrame, key, seq: str = "ingest_seq", version: str = "editorial_version") -> DataFrame:
    """The better row of each key; a tie goes to the one seen first, remote before local.

    ``key`` takes the united table and returns the key column.  The result
    keeps the columns and adds ``position``, where the key was seen first.
    One aggregation by key, so nothing is sorted or ranked.
    """
    columns = remote.columns
    both = remote.withColumn("__side", F.lit(0)).unionByName(local.withColumn("__side", F.lit(1)))
    score = row_score(both, version, (seq, "__side"))
    at = F.struct(F.col("__side"), F.col(seq))
    rank = F.struct(score.alias("score"), (-F.col("__side")).alias("side"), (-F.col(seq)).alias("seq"))
    both = both.select(key(both.drop("__side")).alias("__key"), F.struct(*columns).alias("__row"), rank.alias("__rank"), at.alias("__at"))
    best = both.groupBy("__key").agg(F.max_by("__row", "__rank").alias("__row"), F.min("__at").alias("position"))
    return best.select("__row.*", "position")


def latest_version(df: DataFrame, id_col: str = "telegram_id", version: str = "editorial_version", seq: str = "ingest_seq") -> DataFrame:
    """Per id the row with the highest version; a tie goes to the later line."""
    rank = F.struct(F.coalesce(F.col(version).cast("long"), F.lit(0)), F.col(seq))
    return df.groupBy(F.col(id_col).alias("__id")).agg(F.max_by(F.struct(*df.columns), rank).alias("row")).select("row.*")


def merge_collector_state(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The state that saw further; then the later one; then the local one."""
    both = remote.withColumn("__l", F.lit(0)).unionByName(local.withColumn("__l", F.lit(1)))
    rank = F.struct(F.coalesce("last_seen_id", F.lit(0)), F.coalesce("updated_at", F.lit("")), F.col("__l"))
    return both.agg(F.max_by(F.struct(*remote.columns), rank).alias("row")).where("row is not null").select("row.*")


def merge_prepare_state(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Field-wise largest id and count; the time of the newer side."""
    both = remote.withColumn("__l", F.lit(0)).unionByName(local.withColumn("__l", F.lit(1)))
    newer = F.struct(F.coalesce("updated_at", F.lit("")), F.col("__l"))
    return both.agg(
        F.max(F.coalesce("last_processed_id", F.lit(0))).alias("last_processed_id"),
        F.max(F.coalesce("processed_count", F.lit(0))).alias("processed_count"),
        F.max_by("updated_at", newer).alias("updated_at"),
    )


def advance_state(state: DataFrame, rows: DataFrame, now: Column, id_col: str = "telegram_id") -> DataFrame:
    """A prepare state after these rows: largest id so far, rows counted on."""
    seen = rows.agg(F.max(id_col).alias("top"), F.count("*").alias("n"))
    return state.crossJoin(F.broadcast(seen)).select(  # one row by one row
        F.greatest(F.coalesce("last_processed_id", F.lit(0)), F.coalesce("top", F.lit(0))).alias("last_processed_id"),
        (F.coalesce("processed_count", F.lit(0)) + F.col("n")).alias("processed_count"),
        now.alias("updated_at"),
    )
