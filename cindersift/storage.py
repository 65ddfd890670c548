"""Where intermediate tables go: the shared folder the cluster names, never a machine-local one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named in ``spark.checkpoint.dir``. Only where it is unset and the master is local, one is made."""
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cindersift-")
        spark.conf.set(KEY, folder)
    return folder


def tasks(spark: SparkSession) -> int:
    """A number of tasks that the machines ask for, whatever the sizes of the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over many tasks: where a few bytes of input stand for much work, the number of tasks isn't left to sizes."""
    return df.repartition(tasks(df.sparkSession), *keys)


def written(df: DataFrame, name: str, *, by: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there and no executor holds it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(by) if by else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no result reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
