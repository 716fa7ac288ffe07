"""Words read off rendered pages, by Ghostscript and Tesseract where they are installed.

A page is drawn at DPI and read; the boxes of words are turned from pixels with the
origin above into points with the origin below, as glyphs have them.
"""

from __future__ import annotations

import csv
import io
import os
import pathlib
import shutil
import signal
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .walk import filesystem

TOOLS = ("gs", "tesseract")
WORDS = "file_id string, inside string, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double, conf double"
_ROWS = f"{WORDS}, failed string"
#: Resolution, and seconds that drawing and reading a page may take.
DPI, DRAWING, READING = 200, 300, 600
#: Neighbouring pages that one task reads, so that it fetches their file once.
PAGES = 8


def missing() -> list[str]:
    return [t for t in TOOLS if shutil.which(t) is None]


def words(table: str, page: int, dpi: int = DPI) -> Iterator[dict]:
    """Rows of a page from Tesseract's table; its first row of level 1 states the page's height."""
    height, n, scale = 0.0, 0, 72 / dpi
    for r in csv.DictReader(io.StringIO(table), delimiter="\t", quoting=csv.QUOTE_NONE):
        left, top, wide, high = (float(r[c]) * scale for c in ("left", "top", "width", "height"))
        if r["level"] == "1":
            height = high
        if r["level"] == "5" and (text := (r["text"] or "").strip()):
            n += 1
            yield {"page": page, "word_no": n, "text": text, "x0": left, "y0": height - top - high, "x1": left + wide, "y1": height - top, "conf": float(r["conf"])}


@dataclass(frozen=True)
class Engine:
    """The two programs, and the seconds that drawing or reading a page may take."""

    gs: str = TOOLS[0]
    tesseract: str = TOOLS[1]
    drawing: float = DRAWING
    reading: float = READING

    def draw(self, pdf: pathlib.Path, page: int, picture: pathlib.Path) -> None:
        one = [f"-dFirstPage={page}", f"-dLastPage={page}", f"-sOutputFile={picture}", str(pdf)]
        _call([self.gs, "-q", "-dSAFER", "-dBATCH", "-dNOPAUSE", "-sDEVICE=png16m", f"-r{DPI}", *one], self.drawing)

    def read(self, picture: pathlib.Path) -> str:
        return _call([self.tesseract, str(picture), "-", "tsv"], self.reading).decode("utf-8", "replace")


def _call(command: list[str], limit: float) -> bytes:
    """What a program writes; beyond its limit it ends, with all that it has started."""
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True) as p:
        try:
            out, _ = p.communicate(timeout=limit)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            raise
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, command)
    return out


def _page(engine: Engine, pdf: pathlib.Path, page: int) -> Iterator[dict]:
    """The words of a page, or a row with the reason why there are none."""
    picture = pdf.with_name("page.png")
    step = "drawn"
    try:
        engine.draw(pdf, page, picture)
        step = "read"
        yield from list(words(engine.read(picture), page))
    except subprocess.TimeoutExpired as e:
        yield {"page": page, "failed": f"page {page} was not {step} within {e.timeout:g} seconds; its words were not compared"}
    except (subprocess.CalledProcessError, OSError, ValueError, KeyError, TypeError) as e:
        yield {"page": page, "failed": f"page {page} could not be {step} ({type(e).__name__}); its words were not compared"}
    finally:
        picture.unlink(missing_ok=True)


def _reader(address: str, engine: Engine):
    names = [c.split()[0] for c in _ROWS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(address)
        single = system.get_file_info(root).type == fs.FileType.File
        with tempfile.TemporaryDirectory(prefix="pages-") as own:
            pdf, held, reason = pathlib.Path(own) / "in.pdf", None, ""
            for batch in batches:
                for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key != held:
                        held, reason = key, ""
                        try:
                            with system.open_input_stream(root if single else f"{root.rstrip('/')}/{key}") as source, pdf.open("wb") as copy:
                                shutil.copyfileobj(source, copy, 1 << 20)
                        except OSError as e:
                            reason = f"could not be read ({type(e).__name__}: the file did not open); its words were not compared"
                    rows = [{"page": page, "failed": f"page {page} {reason}"}] if reason else list(_page(engine, pdf, page))
                    columns = [pa.array([{"file_id": key, "inside": "", **r}.get(n) for r in rows], types[c.split()[1]]) for n, c in zip(names, _ROWS.split(", "))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Reading:
    """The words on the pages of PDF files, stored once: seconds of work a page are not done again for a lost executor.

    pages(file_id, inside, page): every page is a row, dealt out with its neighbours; a task fetches a file itself, so no
    file is shuffled.  A page that fails, or takes longer than it may, costs a remark and no other page.  Packages
    inside a file are not read.
    """

    def __init__(self, spark: SparkSession, address: str, pages: DataFrame, stored_at: str, engine: Engine | None = None):
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = pages.where("inside = ''").select("file_id", "page").distinct().repartition(tasks, "file_id", F.floor((F.col("page") - 1) / PAGES)).sortWithinPartitions("file_id", "page")
        dealt.mapInArrow(_reader(address, engine or Engine()), _ROWS).write.parquet(stored_at)
        self._all = spark.read.schema(_ROWS).parquet(stored_at)

    def words(self) -> DataFrame:
        return self._all.where("failed is null").drop("failed")

    def remarks(self) -> DataFrame:
        """remarks(file_id, inside, seq, text): a row a page that was not read."""
        return self._all.where("failed is not null").select("file_id", "inside", F.col("page").cast("long").alias("seq"), F.col("failed").alias("text"))
