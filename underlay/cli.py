"""python -m underlay.cli FILE_OR_FOLDER [--files] [--json | --markdown | --html] [--out FOLDER] [--ocr] [--only NAMES]: scan, report, exit status 0, 1 or 2."""

from __future__ import annotations

import argparse
import contextlib
import shutil
import sys
import tempfile

from pyarrow import fs

from .operators import survey
from .plans import detectors
from .plans.scan import findings_of, remarks_of
from .sources import rendered, reports, sinks
from .sources.casefiles import Records
from .sources.walk import case_files, filesystem


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="underlay")
    p.add_argument("address", help="a file or folder; any file system that pyarrow knows")
    p.add_argument("--records", help="where record tables are stored, a folder that all machines share; on one machine a folder of its own, removed at the end")
    p.add_argument("--files", action="store_true", help="of a folder, each file's findings instead of a survey")
    p.add_argument("--out", metavar="FOLDER", help="executors write a report a file there, and a manifest; on a cluster, a folder that all machines share")
    p.add_argument("--ocr", action="store_true", help="read the rendered pages of PDF files too; takes seconds a page")
    p.add_argument("--only", metavar="NAMES", help=f"these detectors alone, separated by commas, of: {', '.join(detectors.REGISTRY)}")
    for form in ("json", "markdown", "html"):
        p.add_argument(f"--{form}", action="store_const", dest="form", const=form)
    args = p.parse_args(argv)
    system, path = filesystem(args.address)
    folder = system.get_file_info(path).type == fs.FileType.Directory
    if args.ocr and rendered.missing():
        p.error(f"--ocr needs {' and '.join(rendered.missing())}")
    only = [n.strip() for n in args.only.split(",")] if args.only else None
    try:
        if not detectors.chosen(only, ["ocr"] if args.ocr else []):
            p.error("these detectors need --ocr")
    except ValueError as e:
        p.error(str(e))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not args.records and not spark.sparkContext.master.startswith("local"):
        p.error("on a cluster, --records names a folder that all machines share")
    with contextlib.ExitStack() as stack:
        stored = args.records
        if not stored:
            own = tempfile.mkdtemp(prefix="records-")
            stack.callback(shutil.rmtree, own, ignore_errors=True)
            stored = f"{own}/t"
        records = Records(case_files(spark, args.address), stored)
        stack.callback(records.forget)
        reading = rendered.Reading(spark, args.address, records["pages"], f"{stored.rstrip('/')}-ocr") if args.ocr else None
        # Findings are stored beside the records, so that a lost executor costs a reading of files, and nothing runs the detectors twice.
        findings_of(records, reading.words() if reading else None, only=only).write.parquet(f"{stored.rstrip('/')}-found")
        found, unread = spark.read.parquet(f"{stored.rstrip('/')}-found"), reading.remarks() if reading else None
        if args.out:
            made = reports.write(records.files(), found, remarks_of(records, unread), args.form or "text", args.out)
            print(f"{args.out}: {made['reports']} reports; {made['hiding']} of these files hide something, {made['refused']} could not be read")
            return sinks.exit_status(made["reports"], made["reports"] - made["refused"], made["findings"])
        return report(args.address, records, found, args.form, folder and not args.files, unread=unread)


def report(root: str, records, found, form: str | None, as_survey: bool, out=None, unread=None) -> int:
    """Writes the report line by line; rows come from the executors partition by partition.  unread: remarks on pages whose picture was not read."""
    write = lambda line: print(line, file=out or sys.stdout)
    files, said = records.files(), remarks_of(records, unread)
    total = survey.totals(files, found).first()
    if form == "json":
        texts = (r["json"] for r in sinks.scan_json(files, found, said).orderBy("file_id").toLocalIterator())
        for line in sinks.survey_json(root, total, texts) if as_survey else texts:
            write(line)
    elif as_survey:
        show = {"markdown": sinks.survey_markdown, "html": sinks.survey_page}.get(form, sinks.survey_text)
        parts = (df.toLocalIterator() for df in (survey.files_per_kind(files, found), survey.hiding(files, found), survey.refused(files)))
        for line in show(root, total, *parts):
            write(line)
    else:
        show = {"markdown": sinks.markdown, "html": sinks.page}.get(form, sinks.text)
        for f in sinks.per_file(files, found, said).orderBy("file_id").toLocalIterator():
            write(show(f["rel_path"], f["searched"], f["found"], [*f["said"], *([f"not read: {f['refusal']}"] if f["refusal"] else [])]))
    return total["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
