"""A survey that grows: partial states of what files hide, to which those of new arrivals are merged.

A state holds, for each folder, subject and detector, the exact set of its files as
bitmaps, the number of findings, and the first place.  Sets are merged by or, numbers
by sum and places by least, so states merge in any order and grouping, and totals
of any folder, detector or all are read off them without the findings.

Files are numbered from 1 in order of path, a batch after the other, so a folder's files
lie close together and a bitmap (32,768 numbers) is rarely shared by many folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READ, REFUSED, FOUND = "read", "refused", "found"
PLACE = "struct<path: array<string>, page: int, line: int, `column`: int, emit_phase: int, emit_seq: bigint>"
REGISTER = "file_id string, rel_path string, refused boolean, number bigint"
STATE = f"folder string, subject string, detector string, bucket bigint, files binary, findings bigint, first {PLACE}"
#: Rows of a task's numbering, as monotonically_increasing_id() lays them out.
_PART = 1 << 33


def numbered(files: DataFrame, after: int, at: str) -> DataFrame:
    """REGISTER rows of files(file_id, rel_path, refusal), each file once, numbered from after + 1 in order of path; stored at `at`.

    Rows are dealt out by ranges of paths and counted task by task; only those counts meet in one place.
    """
    spark = files.sparkSession
    once = files.groupBy("file_id").agg(F.min(F.struct("rel_path", F.col("refusal").isNotNull().alias("refused"))).alias("f")).select("file_id", "f.*")
    parts = F.split("rel_path", "/")
    laid = once.repartitionByRange(parts).sortWithinPartitions(parts).withColumn("place", F.monotonically_increasing_id())
    laid.write.mode("overwrite").parquet(at)
    laid = spark.read.schema("file_id string, rel_path string, refused boolean, place bigint").parquet(at)
    task = F.floor(F.col("place") / _PART)
    counts = laid.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))  # a row a task
    return laid.join(F.broadcast(before), task == F.col("task")).select("file_id", "rel_path", "refused", (F.col("before") + F.col("place") % _PART + 1 + after).alias("number"))


def _folder(rel_path: str) -> Column:
    parts = F.split(rel_path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("files").alias("files"), F.sum("findings").alias("findings"), F.min("first").alias("first"))


def partial(register: DataFrame, findings: DataFrame) -> DataFrame:
    """The STATE of registered files and of their findings; those of other files are left out."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    place = [zero("page", "int"), zero("line", "int"), zero("column", "int"), F.col("emit_phase").cast("int").alias("emit_phase"), F.col("emit_seq").cast("long").alias("emit_seq")]
    by_file = findings.groupBy("file_id", "detector").agg(F.count("*").alias("findings"), F.min(F.struct(*place)).alias("at"))
    found = register.join(by_file, "file_id").select("rel_path", "number", F.lit(FOUND).alias("subject"), "detector", "findings", F.struct(F.split("rel_path", "/").alias("path"), "at.*").alias("first"))
    seen = register.select("rel_path", "number", F.when(F.col("refused"), REFUSED).otherwise(READ).alias("subject"), F.lit("").alias("detector"), F.lit(0).cast("long").alias("findings"), F.lit(None).cast(PLACE).alias("first"))
    rows = found.unionByName(seen).withColumn("folder", _folder("rel_path")).withColumn("bucket", F.bitmap_bucket_number("number"))
    return rows.groupBy("folder", "subject", "detector", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("files"), F.sum("findings").alias("findings"), F.min("first").alias("first"))


def merged(state: DataFrame) -> DataFrame:
    """Rows of any number of states as one state."""
    return _merged(state, "folder", "subject", "detector")


def totals(state: DataFrame) -> DataFrame:
    """folder, detector, files, read, refused, hiding, findings, first: a row for each folder, with all that lies below it, and each detector.

    The folder '' is all of them; the detector null stands for any: only its rows have files, read and refused. hiding: files with findings, each
    once, whatever detectors they have.  first: the first of them by path.
    """
    leaf = merged(state)
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    which = F.when(F.col("subject") == FOUND, F.array("detector", F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string")))
    spread = leaf.withColumn("detector", F.explode(which)).withColumn("folder", F.explode(above))
    of = lambda subject: F.coalesce(F.sum(F.when(F.col("subject") == subject, F.bitmap_count("files"))), F.lit(0))
    out = _merged(spread, "folder", "subject", "detector").groupBy("folder", "detector").agg(of(READ).alias("read"), of(REFUSED).alias("refused"), of(FOUND).alias("hiding"), F.sum("findings").alias("findings"), F.min("first").alias("first"))
    anything = lambda c: F.when(F.col("detector").isNull(), c)
    return out.select("folder", "detector", anything(F.col("read") + F.col("refused")).alias("files"), anything(F.col("read")).alias("read"), anything(F.col("refused")).alias("refused"), "hiding", "findings", F.array_join("first.path", "/").alias("first"))


class Growing:
    """Batches of arrivals, stored in a folder that all machines share, numbered 0, 1, 2 ... by the caller.

    A batch that is added again, as after a failure, overwrites its own rows, so nothing counts twice; with foreachBatch the
    stream's own number serves.  A file that an earlier batch holds is passed over with its findings: one that has changed
    comes under a new id.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _rows(self, name: str, schema: str, key: str, where: Column) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{schema}, {key} int")
        return self.spark.read.schema(f"{schema}, {key} int").parquet(f"{self.at}/{name}").where(where)

    def add(self, number: int, files: DataFrame, findings: DataFrame) -> None:
        """The files of a batch that no earlier batch holds, and their findings."""
        known = self._rows("register", REGISTER, "batch", F.col("batch") < number)
        last = known.agg(F.max("number")).first()[0] or 0
        fresh = numbered(files.join(known.select("file_id"), "file_id", "left_anti"), last, f"{self.at}/laid/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{self.at}/register/batch={number}")
        register = self.spark.read.schema(REGISTER).parquet(f"{self.at}/register/batch={number}")
        partial(register, findings).write.mode("overwrite").parquet(f"{self.at}/state/batch={number}")

    def settle(self, upto: int) -> None:
        """Stores the states of batches 0 to upto as one, so that later readings are of as many rows as there are folders and detectors."""
        merged(self.state(upto)).write.mode("overwrite").parquet(f"{self.at}/settled/upto={upto}")

    def state(self, upto: int | None = None) -> DataFrame:
        """The greatest settled state, and the states of the batches after it (to the batch upto, if one is named)."""
        within = lambda c: F.lit(True) if upto is None else F.col(c) <= upto
        settled = self._rows("settled", STATE, "upto", F.lit(True) if upto is None else F.col("upto") < upto)
        base = settled.agg(F.max("upto")).first()[0]
        late = self._rows("state", STATE, "batch", within("batch") if base is None else within("batch") & (F.col("batch") > base)).drop("batch")
        return late if base is None else settled.where(F.col("upto") == base).drop("upto").unionByName(late)

    def totals(self) -> DataFrame:
        return totals(self.state())
