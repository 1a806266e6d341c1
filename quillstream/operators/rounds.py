"""Reliable checkpoints for operators that go in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine makes one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstream-rounds-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Eagerly written to the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """Eagerly written to the shared folder as compressed Parquet, for rows that hold words; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    jvm.System.gc()  # Spark deletes the shuffle files of earlier steps when the driver has collected their garbage
    return spark.read.parquet(path)
