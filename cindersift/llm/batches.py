"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most 4 MB (a longer row is a batch of its own). A smaller setting stays."""
    now = spark.conf.get(KEY, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BYTES:
        spark.conf.set(KEY, f"{BYTES}b")
    return spark
