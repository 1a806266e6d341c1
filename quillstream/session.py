"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "quillstream", **conf: str) -> SparkSession:
    """A session with the settings the library's results rely on (UTC, ANSI).

    Cluster-wide sizes (shuffle partitions, memory) are left to AQE and the
    caller; pass them as ``conf`` with dots replaced by double underscores.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
