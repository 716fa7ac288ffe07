"""Pages read by programs that fail or hang: each costs a remark of its own page."""

import time

from underlay.sources import rendered

DRAW = """#!/bin/sh
for a in "$@"; do case $a in -dFirstPage=*) n=${a#*=};; -sOutputFile=*) o=${a#*=};; esac; done
[ "$n" = 2 ] && exit 1
[ "$n" = 3 ] && sleep 60
echo "$n" > "$o"
"""
READ = """#!/bin/sh
n=$(cat "$1")
[ "$n" = 4 ] && sleep 60
[ "$n" = 5 ] && { echo junk; echo 1; exit 0; }
printf 'level\\tleft\\ttop\\twidth\\theight\\tconf\\ttext\\n1\\t0\\t0\\t1700\\t2200\\t-1\\t\\n5\\t200\\t100\\t300\\t50\\t91.5\\tword%s\\n' "$n"
"""


def test_failing_and_hanging_pages(spark, tmp_path):
    tools = []
    for name, script in (("draw", DRAW), ("read", READ)):
        tools.append(tmp_path / name)
        tools[-1].write_text(script)
        tools[-1].chmod(0o755)
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF-1.4")
    (folder / "sub" / "b.pdf").write_bytes(b"%PDF-1.4")
    wanted = [("a.pdf", "", p) for p in range(1, 20)] + [("sub/b.pdf", "", 1), ("sub/b.pdf", "", 1), ("gone.pdf", "", 1), ("gone.pdf", "", 2), ("a.pdf", "inner.pdf", 1)]
    pages = spark.createDataFrame(wanted, "file_id string, inside string, page int")
    start = time.perf_counter()
    reading = rendered.Reading(spark, str(folder), pages, str(tmp_path / "ocr"), rendered.Engine(*map(str, tools), drawing=2, reading=2))
    assert time.perf_counter() - start < 50
    assert {(r.file_id, r.page, r.text) for r in reading.words().collect()} == {("a.pdf", p, f"word{p}") for p in range(1, 20) if p not in (2, 3, 4, 5)} | {("sub/b.pdf", 1, "word1")}
    said = {(r.file_id, r.seq): r.text for r in reading.remarks().collect()}
    assert sorted(said) == [("a.pdf", 2), ("a.pdf", 3), ("a.pdf", 4), ("a.pdf", 5), ("gone.pdf", 1), ("gone.pdf", 2)]
    assert said["a.pdf", 2].startswith("page 2 could not be drawn") and said["a.pdf", 3].startswith("page 3 was not drawn within 2 seconds")
    assert said["a.pdf", 4].startswith("page 4 was not read within 2 seconds") and said["a.pdf", 5].startswith("page 5 could not be read")
    assert said["gone.pdf", 2].startswith("page 2 could not be read")


def test_one_file_and_no_pages(spark, tmp_path):
    for name, script in (("draw", DRAW), ("read", READ)):
        (tmp_path / name).write_text(script)
        (tmp_path / name).chmod(0o755)
    (tmp_path / "one.pdf").write_bytes(b"%PDF-1.4")
    engine = rendered.Engine(str(tmp_path / "draw"), str(tmp_path / "read"))
    page = spark.createDataFrame([("one.pdf", "", 7)], "file_id string, inside string, page int")
    got = rendered.Reading(spark, str(tmp_path / "one.pdf"), page, str(tmp_path / "ocr1"), engine)
    assert [(r.page, r.text, r.conf) for r in got.words().collect()] == [(7, "word7", 91.5)] and got.remarks().count() == 0
    assert rendered.Reading(spark, str(tmp_path), page.where("page = 0"), str(tmp_path / "ocr2"), engine).words().count() == 0
