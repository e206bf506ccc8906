"""What the operators share: reading tables, tables that cut lineage, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where spark.checkpoint.dir is unset, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"

_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (spark.checkpoint.dir); what is in it goes when the driver ends.

    Without that setting a cluster has no such folder, and this raises; one machine uses a folder of its own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        top = LOCAL_SHARED_DIR
    path = f"{top}/spanview-{spark.sparkContext.applicationId}"
    if path not in _paths:
        where, files = _file(spark, path)
        files.deleteOnExit(where)
        _paths.append(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanview_path = path
    return out


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _file(spark, path)
    files.delete(where, True)
    if path in _paths:
        _paths.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame that written() returned."""
    _delete(df.sparkSession, df._spanview_path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, written; the tables that were written on the way to it are deleted."""
    before = len(_paths)
    out = written(make(), name)
    for path in _paths[before:-1]:
        if not path.rsplit("/", 1)[-1].startswith("spanview-"):
            _delete(out.sparkSession, path)
    return out


def columns(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns of df, whatever characters their names have, without those of some names in any case."""
    left_out = {x.lower() for x in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in left_out]


def numbered(df: DataFrame, without: Iterable[str] = (), **more: Column) -> tuple[DataFrame, list[Column]]:
    """df with its columns named by number, and more columns beside them; and the columns to select for the old names.

    Whatever names df's columns have, they meet none of an operator's own.
    """
    kept = columns(df, without)
    left_out = {x.lower() for x in without}
    back = [F.col(f"_c{i}").alias(name) for i, name in enumerate(x for x in df.columns if x.lower() not in left_out)]
    return df.select(*(c.alias(f"_c{i}") for i, c in enumerate(kept)), *(c.alias(name) for name, c in more.items())), back


def spread(key: Column) -> Column:
    """A bigint key, its value unchanged, as a column that Spark deals out anew.

    Both sides of a join on it then come from shuffles of their own, so that Spark can split a hot key.
    """
    return key.bitwiseXOR(F.lit(0).cast("bigint"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(value: int) -> int:
    """The 64 bits of an unsigned integer as Spark's signed bigint."""
    return value - (1 << 64) if value >= 1 << 63 else value
