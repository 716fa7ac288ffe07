"""A folder of files as a table.

Folders are listed by executors, level by level: the names of a level are stored in the
shared folder, and its own folders are dealt out anew for the next.  The driver learns
how many folders a level has, and no name.  Any file system that an address names
serves, and no name is dropped for its first letter but a dot: Spark's own file source
passes over names that begin with an underscore.

A folder that cannot be listed is a row without content, like a file that cannot be
opened, so it is reported as not read.  Links to folders are not followed on a local
file system, since they may go round in circles.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

NAMES = "path string, rel_path string, length long, folder boolean, listed boolean"
FILES = "path string, rel_path string, length long, content binary"
BATCH_BYTES = 32 << 20
#: Folders that one task lists, and names of a batch.
TASK_FOLDERS, BATCH_NAMES = 1_000, 20_000
#: Spark's binary values are shorter than 2 GB; a longer file is not opened.
LONGEST = (1 << 31) - (1 << 20)

_NAMES = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_()), ("listed", pa.bool_())])
_FILES = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def filesystem(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def _entries(system: fs.FileSystem, path: str, rel: str) -> Iterator[tuple]:
    """Rows of NAMES for what a folder holds itself."""
    try:
        found = system.get_file_info(fs.FileSelector(path))
    except OSError:
        yield path, rel, 0, False, False
        return
    for entry in found:
        name = posixpath.basename(entry.path)
        folder = entry.type == fs.FileType.Directory
        if name.startswith(".") or not (folder or entry.type == fs.FileType.File) or (folder and isinstance(system, fs.LocalFileSystem) and os.path.islink(entry.path)):
            continue
        yield entry.path, f"{rel}/{name}" if rel else name, entry.size or 0, folder, True


def _lister(address: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(address)
        held: list[tuple] = []
        for batch in batches:
            for path, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _entries(system, path, rel):
                    held.append(row)
                    if len(held) == BATCH_NAMES:
                        yield _batch(held, _NAMES)
                        held = []
        if held:
            yield _batch(held, _NAMES)

    return run


def walk(spark: SparkSession, address: str) -> DataFrame:
    """path, rel_path, length, listed of every file below a folder, or of the one file that the address names.

    listed is false for a folder that could not be listed, which stands for what it may hold.  rel_path of that is the folder's, and '' for the
    address itself.
    """
    system, root = filesystem(address)
    info = system.get_file_info(root)
    if info.type != fs.FileType.Directory:
        return spark.createDataFrame([(root, posixpath.basename(root), info.size or 0, True)], "path string, rel_path string, length long, listed boolean")
    stored, level, folders = shared_path(spark, "names"), 0, 1
    above = spark.createDataFrame([(root, "")], "path string, rel_path string")
    while folders:
        tasks = max(min(folders, spark.sparkContext.defaultParallelism), -(-folders // TASK_FOLDERS))
        above.repartition(tasks).mapInArrow(_lister(address), NAMES).write.parquet(f"{stored}/level={level}")
        above = spark.read.schema(NAMES).parquet(f"{stored}/level={level}").where("folder").select("path", "rel_path")
        folders, level = above.count(), level + 1
    return spark.read.schema(f"{NAMES}, level int").parquet(stored).where("not folder").select("path", "rel_path", "length", "listed")


def _opener(address: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(address)
        held, size = [], 0
        for batch in batches:
            for path, rel, length, listed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                content = None
                if listed and length < LONGEST:
                    try:
                        with system.open_input_stream(path) as f:
                            content = f.read(LONGEST)
                    except OSError:
                        content = None
                if held and size + len(content or b"") > BATCH_BYTES:
                    yield _batch(held, _FILES)
                    held, size = [], 0
                held.append((path, rel, length, content))
                size += len(content or b"")
        if held:
            yield _batch(held, _FILES)

    return run


def case_files(spark: SparkSession, address: str) -> DataFrame:
    """FILES: every file below a folder with its bytes, which are read where the row goes; large files of one folder are dealt out too."""
    names = walk(spark, address)
    n, size = names.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-size // BATCH_BYTES))
    return names.select("path", "rel_path", "length", "listed").repartition(int(tasks)).mapInArrow(_opener(address), FILES)
