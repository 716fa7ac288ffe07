"""What the operators share on the driver's side: sizes, shared storage, blocks of broadcast data."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, one of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder: a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder as compressed Parquet and read again: for wide rows of which later steps read some columns."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*kept: DataFrame) -> None:
    """Deletes what keep() stored, once nothing needs it, and lets Spark's cleaner take the shuffles that led to it."""
    spark = kept[0].sparkSession
    for df in kept:
        stored = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if stored.isDefined():
            remove(spark, stored.get())
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the files of shuffles that no DataFrame here refers to any more: it goes by the driver's collector."""
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(df: DataFrame, bytes_each: int = 32 << 20, least: int = 0) -> int:
    """Shuffle partitions for work in proportion to df: the session's number (or least), or more for a large input."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A plan without known sizes reports the product of its parts; such a figure says nothing.
    return max(least, min(-(-size // bytes_each), 100_000) if size < 1 << 60 else least)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table from values of the driver.  createDataFrame() would start Python workers to unpickle it; this is an expression."""
    names = [part.split()[0] for part in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}:{part.split()[1]}' for n, part in zip(names, ddl.split(', ')))}>>")).alias("r")).select("r.*")
