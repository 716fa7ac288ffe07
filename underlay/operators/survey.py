"""What a folder's findings say together.

Input: files(file_id, path, rel_path, kind, searched, text_unread, refusal) and findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path() -> Column:
    """Paths compare part by part."""
    return F.split("rel_path", "/")


def files_per_kind(files: DataFrame, findings: DataFrame) -> DataFrame:
    """detector, files (that have it, each once), findings, first (its first file); most files first, then the earliest."""
    by_file = findings.groupBy("file_id", "detector").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("page", F.lit(0)), F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), "emit_phase", "emit_seq")).alias("at"))
    named = by_file.join(files.select("file_id", "rel_path"), "file_id")
    out = named.groupBy("detector").agg(F.count("*").alias("files"), F.sum("n").alias("findings"), F.min(F.struct(_path().alias("p"), "at")).alias("seen"))
    return out.orderBy(F.desc("files"), "seen").select("detector", "files", "findings", F.array_join("seen.p", "/").alias("first"))


def hiding(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with findings in order of path, with their detectors in order of first appearance."""
    seen = findings.groupBy("file_id", "detector").agg(F.min(F.struct(F.coalesce("page", F.lit(0)), F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), "emit_phase", "emit_seq")).alias("at"), F.count("*").alias("n"))
    out = seen.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "detector"))), lambda x: x["detector"]), ", ").alias("detectors"), F.sum("n").alias("findings"))
    return out.join(files.select("file_id", "rel_path"), "file_id").orderBy(_path()).select("file_id", "rel_path", "detectors", "findings")


def refused(files: DataFrame) -> DataFrame:
    return files.where("refusal is not null").orderBy(_path()).select("file_id", "rel_path", "refusal")


def totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, read, refused, hiding, findings, exit_code (2: there are files and none was read; 1: findings; else 0)."""
    read = F.col("refusal").isNull()
    f = files.agg(F.count("*").alias("files"), F.count_if(read).alias("read"), F.count_if(~read).alias("refused"))
    g = findings.agg(F.count_distinct("file_id").alias("hiding"), F.count("*").alias("findings"))
    code = F.when((F.col("files") > 0) & (F.col("read") == 0), 2).when(F.col("findings") > 0, 1).otherwise(0)
    one = F.lit(1).alias("one")  # two single rows
    return f.select("*", one).join(g.select("*", one), "one").drop("one").withColumn("exit_code", code)


def shape_kinds(shapes: DataFrame) -> DataFrame:
    """A row a page, kind of shape and way of painting: how many there are, and the area they take."""
    paint = F.when(F.col("alpha") >= 0.999, "opaque").otherwise("translucent").alias("paint")
    return shapes.groupBy("file_id", "inside", "page", "kind", paint).agg(F.count("*").alias("shapes"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
