"""Files as record tables.

`Records` runs the parsers once over the files of a walk, stores what they give as
typed columns, partitioned by record table, and hands out each table; a file that
cannot be read is a row with a reason, and one that is damaged half-way keeps the
records read before, with a remark.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry
from . import legacy, media, office, pdf
from .records import SCHEMAS, Refused, Sink
from .shared import Bucketed, buckets_for
from .walk import BATCH_BYTES

MAGIC = (("pdf", b"%PDF-"), ("ole2", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("jpeg", b"\xff\xd8\xff"), ("zip", b"PK\x03\x04"))


def magic(content) -> F.Column:
    """What the first eight bytes say; a file's name says nothing."""
    out = None
    for kind, head in MAGIC:
        hit = F.substring(content, 1, len(head)) == F.lit(head)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("plain")


def parse(data: bytes | None, out: Sink) -> None:
    if data is None:
        raise Refused("it could not be opened")
    kind = next((k for k, head in MAGIC if data.startswith(head)), "plain")
    if kind == "zip":
        office.read_zip(data, out)
    elif kind == "jpeg":
        media.read_jpeg(data, out)
    elif kind == "pdf":
        pdf.read_pdf(data, out)
    elif kind == "plain":
        media.read_plain(data, out)
    else:
        legacy.read_compound(data, out)


def read_one(data: bytes | None, inside: str = "") -> Sink:
    """Everything in a file (or, with its name, in a package that a file carries), but for what packages it carries itself."""
    out, refusal = Sink(inside), None
    try:
        parse(data, out)
    except Refused as e:
        refusal = str(e)
    except (RecursionError, MemoryError, ValueError, KeyError, IndexError, AttributeError, TypeError, struct.error) as e:
        if any(out.rows[record] for record in out.rows if record not in ("files", "remarks")):
            out.remark(f"the file is damaged ({type(e).__name__}); what was read before that is all there is")
        else:
            refusal = f"damaged: {type(e).__name__}"
    if refusal:
        out = Sink(inside)
    if not inside or not refusal:
        searched = bool(out.count("units"))
        out.add("files", kind=out.kind, searched=searched, text_unread=out.text_unread, refusal=refusal, sha256=hashlib.sha256(data).hexdigest() if data is not None else "", length=len(data or b""))
    return out


def extract(data: bytes | None) -> list[tuple[str, str, dict]]:
    """(inside, record, fields) of everything in a file, and of the packages it carries, one level down."""
    outer = read_one(data)
    each = [outer, *(read_one(content, name) for name, content in outer.carried)]
    return [(out.inside, record, row) for out in each for record, rows in out.rows.items() for row in rows]


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
#: (name, type) of the record tables' own columns, and their Arrow types.
FIELDS = {record: [tuple(part.rsplit(" ", 1)) for part in ddl.split("inside string, ", 1)[1].split(", ")] for record, ddl in SCHEMAS.items()}
TYPES = {record: pa.struct([(name.strip("`"), _ARROW[t]) for name, t in fields]) for record, fields in FIELDS.items()}
BATCH_ROWS = 20_000


def _stored(only: Iterable[str] | None = None) -> str:
    """The columns of those record tables; of all, if none are named."""
    return ", ".join(["file_id string, inside string, record string", *(f"{record} struct<{', '.join(f'{name}: {t}' for name, t in fields)}>".replace(": long", ": bigint") for record, fields in FIELDS.items() if only is None or record in only)])


STORED = _stored()


def _columns(record: str, rows: list[dict]) -> pa.Array:
    """Rows of one record table as a struct array, made column by column."""
    fields = list(TYPES[record])
    return pa.StructArray.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], fields=fields)


def _parser(only: frozenset[str] | None, nested: bool):
    """Batches of rows of one record table each, gathered over files; the columns of the other wanted ones are null, and there are none of the rest.

    A task reads one file after another.  Nested: of packages (file_id, name, content), which carry no others.
    """
    types = {record: t for record, t in TYPES.items() if only is None or record in only}
    names = ["file_id", "inside", "record", *types]

    def gathered(held: dict[str, list[tuple[str, str, dict]]]) -> Iterator[pa.RecordBatch]:
        for record, every in held.items():
            for lo in range(0, len(every), BATCH_ROWS):
                some = every[lo : lo + BATCH_ROWS]
                n = len(some)
                own = {name: _columns(record, [r for _, _, r in some]) if name == record else pa.nulls(n, t) for name, t in types.items()}
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.string()), pa.array([i for _, i, _ in some], pa.string()), pa.array([record] * n, pa.string()), *own.values()], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[str, str, dict]]] = {}
        rows = carried = 0
        for batch in batches:
            for key, content, *inside in zip(*batch.columns):
                key = key.as_py()
                out = read_one(content.as_py(), inside[0].as_py() if nested else "")
                if not nested:
                    for name, data in out.carried:
                        out.add("carried", name=name, length=len(data), content=data)
                        carried += len(data)
                for record, every in out.rows.items():
                    if only is None or record in only:
                        held.setdefault(record, []).extend((key, out.inside, row) for row in every)
                        rows += len(every)
                if rows >= BATCH_ROWS or carried >= BATCH_BYTES:
                    yield from gathered(held)
                    held, rows, carried = {}, 0, 0
        yield from gathered(held)

    return run


def parsed(files: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """What the parsers give for files (rel_path, content): file_id, inside, record, and a column for each record table wanted.

    Packages that a file carries are rows of the record table `carried`, for parsed_inside.
    """
    only = None if only is None else frozenset(only)
    return files.select("rel_path", "content").mapInArrow(_parser(only, False), _stored(only))


def parsed_inside(carried: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """The same for carried packages (file_id, name, content), one level down."""
    only = None if only is None else frozenset(only)
    return carried.select("file_id", "content", "name").mapInArrow(_parser(only, True), _stored(only))


class Records:
    """The record tables of files(path, rel_path, length, content); the file id is the relative path.

    Files are parsed first.  What they carry is then dealt out anew, over all tasks, whatever file it came from: a
    container of a thousand packages is the work of all, and only its own parts are the work of one.
    """

    def __init__(self, files: DataFrame, stored_at: str, only: Iterable[str] | None = None):
        """stored_at: a folder that driver and executors share.  only: the record tables wanted; all, if none are named."""
        self.spark, self.path = files.sparkSession, stored_at
        self._laid: Bucketed | None = None
        wanted = None if only is None else {*only, "carried"}
        parsed(files, wanted).write.partitionBy("record").parquet(stored_at)
        self._all = self.spark.read.schema(STORED).parquet(stored_at)
        n, size = self["carried"].agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            tasks = max(min(n, self.spark.sparkContext.defaultParallelism), -(-size // BATCH_BYTES))
            parsed_inside(self["carried"].repartition(int(tasks)), wanted).write.mode("append").partitionBy("record").parquet(stored_at)
            self._all = self.spark.read.schema(STORED).parquet(stored_at)

    def __getitem__(self, record: str) -> DataFrame:
        """Reads the files of that record table and its columns alone."""
        return self._all.where(F.col("record") == record).select("file_id", "inside", f"{record}.*")

    def laid(self) -> DataFrame:
        """Glyphs and shapes dealt out by page, stored once, beside the records, for all that reads them."""
        if self._laid is None:
            self._laid = geometry.stored_layout(self["glyphs"], self["shapes"], f"{self.path.rstrip('/')}-laid", buckets_for(self._all))
        return self._laid.table()

    def forget(self) -> None:
        """Takes the laid table out of the catalog again; its files stay with the records."""
        if self._laid is not None:
            self._laid.drop()
            self._laid = None

    def files(self) -> DataFrame:
        """One row a file, not the packages inside."""
        return self["files"].where("inside = ''").withColumn("rel_path", F.col("file_id"))
