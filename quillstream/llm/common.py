"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold on its way to Python; texts are long.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS and ARROW_BYTES if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What this process keeps from task to task, by the operator that made it.
_kept: dict[str, dict] = {}


def own_tables(owner: str) -> dict:
    """What an operator keeps in this process from task to task; called by its tasks before they read.

    Spark reuses its Python workers, so what tasks of other operators left goes first.
    """
    others = [k for k in _kept if k != owner]
    if others:
        for k in others:
            del _kept[k]
        gc.collect()  # such tables refer to each other
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(owner, {})


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a session on one machine gets a folder of its own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstream-checkpoint-"))
    return sc.getCheckpointDir()


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of earlier steps only when the driver has collected their garbage, which a small driver hardly ever does by itself."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    free_shuffles(df.sparkSession)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    free_shuffles(spark)
    return spark.read.parquet(path)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), under the names id and text."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def blocks(values: list, size: int) -> Iterator[list]:
    """Consecutive slices of at most size values."""
    for at in range(0, len(values), size):
        yield values[at : at + size]


#: Bits of a key filter: so many for each key, and at most.
BITS_PER_KEY, MAX_BITS = 16, 1 << 25


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """(key) to one row with an array ``bits`` in which a bit is set for every key, and the number of its bits.

    The row has MAX_BITS bits at most, so it may be broadcast whatever the
    number of keys; the fuller it is, the fewer other keys it rules out.
    """
    n = keys.count()
    size = 1 << min(max(n * BITS_PER_KEY, 64).bit_length(), MAX_BITS.bit_length() - 1)
    bit = F.pmod("key", F.lit(size).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    parts = keys.select(F.shiftright(bit, 6).alias("at"), one.alias("v")).groupBy("at").agg(F.bit_or("v").alias("v"))
    every = keys.sparkSession.range(size // 64).join(parts, F.col("id") == F.col("at"), "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("a"))
    return row.select(F.transform("a", lambda x: x["v"]).alias("bits")), size


def may_have(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is in the table keys (key), and a few others."""
    row, size = key_filter(keys)
    bit = F.pmod(key, F.lit(size).cast("long"))
    word = F.get("bits", F.shiftright(bit, 6).cast("int"))
    hit = word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))) != 0
    return df.crossJoin(F.broadcast(row)).where(hit).select(*df.columns)
