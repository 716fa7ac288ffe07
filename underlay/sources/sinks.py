"""Reports: findings as JSON, Markdown, HTML and text.

JSON is made by executors, one row a file.  The other forms are for a person to
read: of one file, from its row of per_file(), or of a folder, as lines that come
while its rows do, so that a folder of any size can be written out.
"""

from __future__ import annotations

import html
import json
import re
import textwrap
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL, VERSION = "underlay", "2"
SCHEMA = "underlay-scan/1"
SURVEY = "underlay-survey/1"


def per_file(files: DataFrame, findings: DataFrame, remarks: DataFrame) -> DataFrame:
    """files with found (an array of findings in order) and said (an array of remarks): one job for any number of files."""
    order = [F.coalesce("page", F.lit(0)).alias("p"), F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("column", F.lit(0)).alias("c"), F.col("emit_phase").alias("ph"), F.col("emit_seq").alias("s"), F.col("detector").alias("d")]
    fields = F.struct("detector", "basis", "summary", "human_sees", "machine_reads", "page", "line", "column", "inside", "codepoints", "decoded")
    found = findings.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, fields.alias("f")))), lambda x: x["f"]).alias("found"))
    rank = ["inside", *(c for c in ("phase",) if c in remarks.columns), "seq", "text"]
    said = remarks.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*rank))), lambda x: x["text"]).alias("said"))
    joined = files.join(found, "file_id", "left").join(said, "file_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.array())).withColumn("said", F.coalesce("said", F.array()))


def json_text() -> Column:
    """The JSON text of a row of per_file(); to_json() leaves out what is empty."""

    def finding(f: Column) -> Column:
        place = F.struct(f["page"].alias("page"), f["line"].alias("line"), f["column"].alias("column"), F.when(f["inside"] != "", f["inside"]).alias("inside"))
        plain = [f[c].alias(c) for c in ("detector", "basis", "summary", "human_sees", "machine_reads")]
        return F.struct(*plain, place.alias("location"), f["codepoints"].alias("codepoints"), f["decoded"].alias("decoded"))

    return F.to_json(F.struct(F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("version"), F.lit(SCHEMA).alias("schema"), F.col("file_id").alias("file"), "sha256", "kind", "searched", "refusal", F.col("said").alias("remarks"), F.transform("found", finding).alias("findings")))


def scan_json(files: DataFrame, findings: DataFrame, remarks: DataFrame) -> DataFrame:
    """(file_id, json): one JSON text a file, findings in order."""
    return per_file(files, findings, remarks).select("file_id", json_text().alias("json"))


def exit_status(files: int, read: int, findings: int) -> int:
    """2: there are files and none was read; 1: something was found; 0: nothing was."""
    return 2 if files and not read else 1 if findings else 0


def _place(r) -> str:
    parts = [f"{name} {r[name]}" for name in ("page", "line", "column") if r[name] is not None]
    return ", ".join(parts) + (f" in {r['inside']}" if r["inside"] else "") or "whole file"


def headline(searched: bool, findings: int) -> str:
    if findings:
        return f"{findings} finding" + ("" if findings == 1 else "s")
    return "nothing hidden found" if searched else "there was no text to search"


def text(title: str, searched: bool, rows: list, remarks: list[str] = (), width: int = 88) -> str:
    """Wrapped, never cut; findings grouped by kind in order of first appearance."""
    out = [title, headline(searched, len(rows)), ""]
    for kind in dict.fromkeys(r["detector"] for r in rows):
        out.append(kind)
        for r in (x for x in rows if x["detector"] == kind):
            out += textwrap.wrap(f"[{r['basis']}] {_place(r)}: {r['summary']}", width, initial_indent="  ", subsequent_indent="    ")
            for label, value in (("a reader sees", r["human_sees"]), ("a machine reads", r["machine_reads"]), ("it spells", r["decoded"])):
                if value:
                    out += textwrap.wrap(f"{label}: {value}", width, initial_indent="    ", subsequent_indent="      ", break_long_words=True, replace_whitespace=False)
        out.append("")
    return "\n".join([*out, *(f"note: {x}" for x in remarks)]).rstrip() + "\n"


def _fenced(value: str) -> str:
    """A code block whose fence is longer than any run of backticks in it."""
    ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", value)), default=0))
    return f"{ticks}\n{value}\n{ticks}"


def _escaped(value: str) -> str:
    return re.sub(r"([\\`*_{}\[\]()#+!|<>~-])", r"\\\1", value.replace("\n", " "))


def markdown(title: str, searched: bool, rows: list, remarks: list[str] = ()) -> str:
    out = [f"# {_escaped(title)}", headline(searched, len(rows))]
    for r in rows:
        out += [f"## {_escaped(r['detector'])} ({r['basis']}), {_escaped(_place(r))}", _escaped(r["summary"])]
        out += [f"{label}:\n\n{_fenced(value)}" for label, value in (("A reader sees", r["human_sees"]), ("A machine reads", r["machine_reads"])) if value]
    return "\n\n".join([*out, *(f"> {_escaped(x)}" for x in remarks)]) + "\n"


def page(title: str, searched: bool, rows: list, remarks: list[str] = ()) -> str:
    """HTML without scripts; everything from a file is escaped."""
    e = html.escape
    body = [f"<h1>{e(title)}</h1><p>{headline(searched, len(rows))}</p>"]
    for i, r in enumerate(rows, 1):
        seen = "".join(f"<dt>{label}</dt><dd><pre>{e(value)}</pre></dd>" for label, value in (("a reader sees", r["human_sees"]), ("a machine reads", r["machine_reads"])) if value)
        body.append(f'<section id="f{i}"><h2>{e(r["detector"])} <small>{e(r["basis"])}, {e(_place(r))}</small></h2><p>{e(r["summary"])}</p><dl>{seen}</dl></section>')
    notes = "".join(f"<li>{e(x)}</li>" for x in remarks)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body>{"".join(body)}<ul>{notes}</ul></body></html>\n'


# Surveys of a folder: lines, from its totals and from rows that may come one by one.


def _count(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def survey_tail(total) -> str:
    """What was searched, and what was not: never one without the other."""
    if not total["files"]:
        return "there are no files here to read"
    if not total["read"]:
        return f"none of {_count(total['files'], 'file')} could be read, so nothing was searched"
    more = f"; {_count(total['refused'], 'file')} could not be read, so nothing in them was searched" if total["refused"] else ""
    return f"searched {_count(total['read'], 'file')}{more}"


def _sections(total, kinds: Iterable, hiding: Iterable, refused: Iterable):
    """(heading, rows of label and value) of a survey."""
    yield "", iter([("read", f"{_count(total['read'], 'file')}, {_count(total['findings'], 'finding')}"), ("not read", _count(total["refused"], "file"))])
    yield "what was found", ((r["detector"], f"{_count(r['files'], 'file')}, first in {r['first']}") for r in kinds)
    yield "files that hide something", ((r["rel_path"], r["detectors"]) for r in hiding)
    yield "not read", ((r["rel_path"], r["refusal"]) for r in refused)


def survey_text(root: str, total, kinds: Iterable, hiding: Iterable, refused: Iterable, width: int = 88) -> Iterator[str]:
    yield f"{root}: {total['hiding']} of {_count(total['files'], 'file')} hide something"
    for heading, rows in _sections(total, kinds, hiding, refused):
        for i, (label, value) in enumerate(rows):
            if not i:
                yield f"\n{heading}" if heading else ""
            yield from textwrap.wrap(f"{label}: {value}", width, initial_indent="  ", subsequent_indent="    ", break_long_words=True, break_on_hyphens=False)
    yield ""
    yield survey_tail(total)


def survey_markdown(root: str, total, kinds: Iterable, hiding: Iterable, refused: Iterable) -> Iterator[str]:
    yield f"# {_escaped(root)}"
    yield f"\n{total['hiding']} of {_count(total['files'], 'file')} hide something"
    for heading, rows in _sections(total, kinds, hiding, refused):
        for i, (label, value) in enumerate(rows):
            if not i:
                yield f"\n## {heading}\n" if heading else ""
            yield f"- {_escaped(label)}: {_escaped(value)}"
    yield f"\n{survey_tail(total)}"


def survey_page(root: str, total, kinds: Iterable, hiding: Iterable, refused: Iterable) -> Iterator[str]:
    e = html.escape
    yield f'<!doctype html><html><head><meta charset="utf-8"><title>{e(root)}</title></head><body><h1>{e(root)}</h1><p>{total["hiding"]} of {_count(total["files"], "file")} hide something</p>'
    for heading, rows in _sections(total, kinds, hiding, refused):
        for i, (label, value) in enumerate(rows):
            if not i and heading:
                yield f"<h2>{heading}</h2>"
            yield f"<dl><dt>{e(label)}</dt><dd>{e(value)}</dd></dl>"
    yield f"<p>{e(survey_tail(total))}</p></body></html>"


def survey_json(root: str, total, texts: Iterable[str]) -> Iterator[str]:
    """One JSON object; texts: the files' own, as scan_json() gives them."""
    head = json.dumps({"tool": TOOL, "version": VERSION, "schema": SURVEY, "root": root, **{k: total[k] for k in ("files", "read", "refused", "hiding", "findings")}}, ensure_ascii=False)
    yield head[:-1].replace('"files"', '"file_count"', 1) + ', "files": ['
    for i, text_ in enumerate(texts):
        yield ("," if i else "") + text_
    yield "]}"
