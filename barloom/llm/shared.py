"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set with setCheckpointDir.

    Where neither is set a new temporary folder is, but only with a local
    master: on a cluster executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def keep_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """keep(), in buckets by a key: later joins and groups by it need no shuffle of these rows.

    The table's entry in the catalog lives only until the files are known.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    out._kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that keep() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(conf).delete(path, True)
