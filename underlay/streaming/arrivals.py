"""Documents that arrive over time: the character detectors on a stream, each text judged once.

The reference has no streaming; this is an extension over the same plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import characters
from ..operators.findings import union
from ..operators.rollup import Growing


def watch(arrivals: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """arrivals: a stream of units with an `arrived` timestamp; findings go to `out` as Parquet, a folder a batch.

    A file's text that was seen within a day is dropped before it is judged; another file with the same text is not.  A batch that is
    repeated after a failure overwrites its own folder, so nothing counts twice.
    """
    fresh = arrivals.withColumn("digest", F.sha2("text", 256)).withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["file_id", "inside", "unit_no", "digest"]).drop("digest")

    def judge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        union(characters.detect(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    writer = fresh.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_survey(arrivals: DataFrame, at: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The same units with a `rel_path`, as batches of a growing survey stored at `at`; Growing(spark, at).totals() says what all files so far hide.

    A file's units come in one batch.  A batch that is repeated after a failure overwrites its own rows, and a file that comes again in a later
    batch is passed over, without state to keep in the stream.
    """

    def grow(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        files = batch.select("file_id", "rel_path", F.lit(None).cast("string").alias("refusal")).distinct()
        # Units of one text that stand twice in a batch are judged once, as watch() does.
        units = batch.dropDuplicates(["file_id", "inside", "unit_no", "text"])
        Growing(batch.sparkSession, at).add(number, files, union(characters.detect(units)))
        batch.unpersist()

    writer = arrivals.writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
