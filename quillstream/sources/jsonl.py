"""Line-oriented JSON logs and one-object state files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with ingest_seq, their place over all files by name.

    Lines of one split come in order; splits are counted, and the counts (a row
    for each split, not line) give where each split's numbers begin.
    """
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("split"), F.monotonically_increasing_id().alias("id"))
    sizes = raw.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("split", "first", before.alias("before"))
    return raw.join(starts, "split").select("value", (F.col("before") + F.col("id") - F.col("first") + 1).alias("ingest_seq")).where(F.trim("value") != "")


def read_log(spark: SparkSession, path: str, schema: T.StructType, objects_only: bool = False) -> DataFrame:
    """A log with its lines' order in ingest_seq; a missing file is an empty table.

    A malformed line fails the read.  ``objects_only`` leaves lines aside that
    hold JSON but no object; otherwise they are rows of nulls.
    """
    full = T.StructType([*schema.fields, T.StructField("ingest_seq", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    lines = _lines(spark, path)
    valid = F.try_parse_json("value")
    checked = lines.withColumn("value", F.when(valid.isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed line "), F.col("ingest_seq").cast("string")))))
    is_object = F.ltrim("value").startswith("{")
    if objects_only:
        checked = checked.where(is_object)
    parsed = checked.select(F.when(is_object, F.from_json("value", schema)).alias("row"), "ingest_seq")
    return parsed.select("row.*", "ingest_seq")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log folder; nothing happens for an empty table."""
    if not df.isEmpty():
        df.drop("ingest_seq").write.mode("append").option("ignoreNullFields", "false").json(path)


def rewrite_log(df: DataFrame, path: str) -> None:
    """Replaces a log: written beside it first, then renamed, so the path being read is never overwritten."""
    spark = df.sparkSession
    fresh, old = f"{path}.fresh", f"{path}.old"
    order = [c for c in ("position", "ingest_seq") if c in df.columns]
    df.orderBy(*order).drop(*order).write.mode("overwrite").json(fresh)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path_of(old), True)
    if fs.exists(path_of(path)):
        fs.rename(path_of(path), path_of(old))
    fs.rename(path_of(fresh), path_of(path))
    fs.delete(path_of(old), True)


def read_state(spark: SparkSession, path: str, schema: T.StructType, default: dict) -> DataFrame:
    """A one-object file as one row; missing or malformed, and missing fields, give the default."""
    plain = spark.createDataFrame([tuple(default.get(f.name) for f in schema.fields)], schema)
    if not _exists(spark, path):
        return plain
    text = spark.read.option("wholetext", True).text(path).limit(1)
    row = F.when(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.from_json("value", schema))
    found = text.select(row.alias("row")).where("row is not null").select("row.*")
    return plain if found.isEmpty() else found


def write_state(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # one row


def newest_line(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The last line of a log (not the one with the largest id)."""
    return df.agg(F.max_by(F.struct(*df.columns), seq).alias("row")).where("row is not null").select("row.*")
