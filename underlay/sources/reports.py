"""Reports written by executors: a file each, and a manifest that says which of them count.

    df.write.format("underlay-reports").option("form", "html").mode("overwrite").save(folder)

of per_report()'s rows.  Every attempt of a task writes into a folder of its own, with a line a report in
`reports.jsonl`.  commit() names the folders of the attempts that succeeded in `manifest.json`, which comes last, and removes
those of others; abort() removes all of this run.  Only folders of the manifest count, so nothing is moved, and object
stores serve as well.  The driver sees a message a task.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import sinks
from .walk import filesystem

FORMS = {"json": "json", "markdown": "md", "html": "html", "text": "txt"}
MANIFEST, LINES = "manifest.json", "reports.jsonl"
#: File systems allow 255 bytes; a longer name is cut and told by its digest.
LONGEST_NAME = 200


def per_report(files: DataFrame, findings: DataFrame, remarks: DataFrame, form: str) -> DataFrame:
    """A row a file: what its report is made of."""
    whole = sinks.per_file(files, findings, remarks)
    body = [sinks.json_text().alias("json")] if form == "json" else ["searched", "found", "said"]
    return whole.select("file_id", F.size("found").alias("findings"), "refusal", *body)


def report_name(file_id: str, ending: str) -> str:
    """A file's name for a report; different ids have different names."""
    plain = quote(file_id, safe=" ")
    if len(plain) > LONGEST_NAME:
        plain = f"{plain[: LONGEST_NAME // 2]}~{hashlib.sha256(file_id.encode()).hexdigest()}"
    return f"{plain}.{ending}"


def rendered(row, form: str) -> str:
    if form == "json":
        return row["json"] + "\n"
    said = [*row["said"], *([f"not read: {row['refusal']}"] if row["refusal"] else [])]
    return {"markdown": sinks.markdown, "html": sinks.page, "text": sinks.text}[form](row["file_id"], row["searched"], row["found"], said)


@dataclass
class _Part(WriterCommitMessage):
    folder: str
    reports: int
    hiding: int
    findings: int
    refused: int


class Writer(DataSourceWriter):
    def __init__(self, address: str, form: str, overwrite: bool):
        if form not in FORMS:
            raise ValueError(f"a report's form is one of {', '.join(FORMS)}")
        self.address, self.form, self.overwrite, self.run = address, form, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Part:
        system, root = filesystem(self.address)
        part = _Part(f"part-{self.run}-{uuid.uuid4().hex}", 0, 0, 0, 0)
        folder = posixpath.join(root, part.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(posixpath.join(folder, LINES)) as lines:
            for row in iterator:
                name = report_name(row["file_id"], FORMS[self.form])
                with system.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(rendered(row, self.form).encode("utf-8", "replace"))
                lines.write((json.dumps({"file": row["file_id"], "report": name, "findings": row["findings"], "refused": row["refusal"]}) + "\n").encode())
                part.reports += 1
                part.hiding += row["findings"] > 0
                part.findings += row["findings"]
                part.refused += row["refusal"] is not None
        return part

    def _parts(self, system: fs.FileSystem, root: str) -> list[str]:
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [posixpath.basename(f.path) for f in found if f.type == fs.FileType.Directory and posixpath.basename(f.path).startswith("part-")]

    def commit(self, messages: list) -> None:
        system, root = filesystem(self.address)
        system.create_dir(root, recursive=True)
        parts = [vars(m) for m in messages if m is not None and m.reports]
        before = [] if self.overwrite else read_manifest(self.address).get("parts", [])
        every = before + parts
        total = {k: sum(p[k] for p in every) for k in ("reports", "hiding", "findings", "refused")}
        text = json.dumps({"tool": sinks.TOOL, "version": sinks.VERSION, "form": self.form, **total, "parts": every})
        waiting = posixpath.join(root, f".{MANIFEST}-{self.run}")
        with system.open_output_stream(waiting) as out:
            out.write(text.encode())
        system.move(waiting, posixpath.join(root, MANIFEST))
        counted = {p["folder"] for p in every}
        for name in self._parts(system, root):
            if name not in counted and (self.overwrite or name.startswith(f"part-{self.run}-")):
                system.delete_dir(posixpath.join(root, name))

    def abort(self, messages: list) -> None:
        system, root = filesystem(self.address)
        for name in self._parts(system, root):
            if name.startswith(f"part-{self.run}-"):
                system.delete_dir(posixpath.join(root, name))


class Reports(DataSource):
    """df.write.format("underlay-reports")"""

    @classmethod
    def name(cls) -> str:
        return "underlay-reports"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], self.options.get("form", "text"), overwrite)


def read_manifest(address: str) -> dict:
    """What a folder's manifest says; nothing, where there is none."""
    system, root = filesystem(address)
    path = posixpath.join(root, MANIFEST)
    if system.get_file_info(path).type != fs.FileType.File:
        return {}
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def write(files: DataFrame, findings: DataFrame, remarks: DataFrame, form: str, address: str, overwrite: bool = True) -> dict:
    """Writes a report a file, and gives the manifest."""
    spark = files.sparkSession
    spark.dataSource.register(Reports)
    rows = per_report(files, findings, remarks, form)
    rows.write.format("underlay-reports").option("form", form).mode("overwrite" if overwrite else "append").save(address)
    return read_manifest(address)
