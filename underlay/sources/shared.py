"""Tables that a plan stores to read more than once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 64 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir.  Where that is unset, in a folder of our own on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def buckets_for(df: DataFrame, least: int | None = None, size: int = BUCKET_BYTES) -> int:
    """Buckets of so many bytes each by what Spark knows of df's size, and no fewer than Spark shuffles into."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    # A plan without known sizes reports the product of its parts; such a figure says nothing.
    return max(least, min(-(-known // size), most)) if known < 1 << 50 else least


class Bucketed:
    """Rows stored once as a table in buckets of some keys: windows, groups and joins by the keys need no exchange of it.

    A lost executor costs a reading of files.  drop() takes it out of the catalog; the files stay where they are.
    """

    def __init__(self, rows: DataFrame, buckets: int, keys: tuple[str, ...], order: tuple[str, ...], path: str):
        """rows: dealt out into as many partitions by the keys, so that a task writes a bucket."""
        self.spark, self.name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
