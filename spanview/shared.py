"""Tables in the folder that the driver and the executors share: they cut the lineage of what is used again, and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share (spark.checkpoint.dir); it goes when the driver ends. Only one machine does without the setting."""
    top, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not top and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    path = f"{top or '/tmp/checkpoints'}/spanview-{name}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
