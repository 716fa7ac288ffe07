"""Carried packages: rows of their own, dealt out anew; batches gathered over files; streams that are too long."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from underlay.plans import packages as P
from underlay.sources import casefiles as C
from underlay.sources import walk
from underlay.sources import pdf


def container(n, key="c", more=()):
    out = io.BytesIO(P.container({"key": key, "rows": [{"id": i, "name": f"name {i}"} for i in range(n)]}))
    with zipfile.ZipFile(out, "a") as z:
        for name, data in more:
            z.writestr(name, data)
    return out.getvalue()


def files(spark, **contents):
    return spark.createDataFrame([(f"{k}.docx", f"{k}.docx", len(v or b""), v) for k, v in contents.items()], walk.FILES)


def test_one_container_is_the_work_of_all_tasks(spark, tmp_path, monkeypatch):
    f = files(spark, one=container(1000), plain=b"text", gone=None)
    r = C.Records(f, f"file://{tmp_path}/r")
    units = r["units"].where("inside <> ''")
    assert units.count() == 1000 and units.select("inside").distinct().count() == 1000
    assert sorted(x.refusal is not None for x in r.files().collect()) == [False, False, True]
    # The second stage: as many tasks as there are cores, each with a share of the packages.
    tasks = [x.n for x in r["carried"].repartition(4).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) == 4 and max(tasks) - min(tasks) < 50
    assert r["files"].where("inside <> ''").select(F.spark_partition_id().alias("p")).distinct().count() >= 1


def test_descending_says_what_one_parse_says(spark, tmp_path):
    """Names twice, a damaged package, one that is no document, and one that carries another: one level and no more."""
    inner = container(2, "inner")
    data = container(3, "outer", [("word/embeddings/inner.docx", inner), ("word/embeddings/bad.docx", b"PK\x03\x04 damaged"), ("word/embeddings/none.docx", P._zip({"a": "b"})), ("xl/embeddings/s1.docx", P.word({"name": "again", "segment": "s", "author": "A", "id": 2})), ("word/embeddings/x.bin", b"no package")])
    r = C.Records(files(spark, f=data), f"file://{tmp_path}/r")
    want = C.extract(data)
    for record in ("files", "units", "revisions", "attachments", "meta_fields", "remarks"):
        names = [f.name for f in C.TYPES[record]]
        got = sorted(str((x.inside, *(x[n] for n in names))) for x in r[record].collect())
        assert got == sorted(str((i, *(row.get(n) for n in names))) for i, kind, row in want if kind == record), record
    assert {x.inside for x in r["units"].collect()} == {"", "s0.docx", "s1.docx", "s2.docx", "inner.docx"}
    assert {x.name for x in r["attachments"].where("inside = 'inner.docx'").collect()} == {"s0.docx", "s1.docx"}


def test_nothing_to_descend_into(spark, tmp_path):
    r = C.Records(files(spark, a=b"plain"), f"file://{tmp_path}/a", ["units"])
    assert r["carried"].count() == 0 and r["units"].count() == 1 and r["files"].count() == 0
    assert C.Records(files(spark, a=b"x").limit(0), f"file://{tmp_path}/b")["units"].count() == 0


def test_batches_hold_rows_of_many_files():
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(500)]), pa.array([f"text {i}\nline".encode() for i in range(500)], pa.binary())], names=["rel_path", "content"])
    out = list(C._parser(None, False)(iter([batch, batch])))
    assert len(out) <= 4 and sum(b.num_rows for b in out if b.column(2)[0].as_py() == "units") == 1000
    few = list(C._parser(frozenset(["units"]), False)(iter([batch])))
    assert [b.num_rows for b in few] == [500] and few[0].column("units")[7].as_py()["text"] == "text 7\nline"


def test_only_wanted_record_tables_are_sent_and_stored(spark, tmp_path):
    """Neither batches nor stored files have columns of the others; what they hold is the same, also of carried packages."""
    data = container(3)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data], pa.binary())], names=["rel_path", "content"])
    assert {tuple(b.schema.names) for b in C._parser(frozenset(["units", "revisions"]), False)(iter([batch]))} == {("file_id", "inside", "record", "units", "revisions")}
    some, every = (C.Records(files(spark, f=data), f"file://{tmp_path}/{n}", only) for n, only in (("some", ["revisions", "units"]), ("all", None)))
    assert set(spark.read.parquet(f"file://{tmp_path}/some").columns) == {"file_id", "inside", "record", "units", "revisions", "carried"}
    for record in ("units", "revisions"):
        assert some[record].count() == 4 and sorted(some[record].collect()) == sorted(every[record].collect())
    assert some["meta_fields"].count() == 0 and every["meta_fields"].count() == 4


def test_changes_of_formatting_alone_and_within_others():
    """A part without tracked text still says that its formatting was changed; a change inside another is not counted again."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda tag, text: f"<w:r><w:{tag}>{text}</w:{tag}></w:r>"
    body = f"<w:p>{run('t', 'kept')}<w:del w:author='A'>{run('delText', 'gone')}<w:ins>{run('t', 'within')}</w:ins></w:del></w:p>"
    out = C.read_one(P._zip({"word/document.xml": f"<w:d {w}>{body}</w:d>", "word/header1.xml": f"<w:h {w}><w:p><w:rPrChange/>{run('t', 'head')}</w:p></w:h>"}))
    assert [(x["kind"], x["text"], x["author"]) for x in out.rows["revisions"]] == [("deletion", "gonewithin", "A")]
    assert [x["text"] for x in out.rows["units"]] == ["keptwithin", "head"] and len(out.rows["remarks"]) == 1


def test_a_stream_is_read_whole_or_not_at_all(monkeypatch):
    data = P.portable({"key": "1", "id": 1, "name": "Someone " * 50, "segment": "s", "author": "A"})
    whole = C.read_one(data)
    assert whole.count("glyphs") and not whole.count("remarks")
    monkeypatch.setattr(pdf, "LARGEST_STREAM", 40)
    cut = C.read_one(data)
    assert not cut.count("glyphs") and (cut.count("remarks") or cut.rows["files"][0]["refusal"])
