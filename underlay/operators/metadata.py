"""Detectors 19 and 22b to 25b: what a file says of itself.

Input: meta_fields(file_id, inside, seq, name, value, part, role, container), meta_history(.., seq,
action, software, when, changed, instance), files (comparable: its text was read), units, and
images(file_id, inside, w, h, tw, th).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sought
from .findings import CIRCUMSTANTIAL, KEY, SELF_REPORTED, findings

#: An absolute path, the shortest value that is sought, and the Info names with their XMP names.
PATH = r"^(?:/[^/\s][^\s]*|[A-Za-z]:[\\/][^\s]*|\\\\[^\\\s]+\\[^\s]*)$"
SHORTEST = 4
TOLERANCE = 0.02
PAIRS = (
    ("Author", "dc:creator"), ("Title", "dc:title"), ("Subject", "dc:description"), ("Keywords", "pdf:Keywords"),
    ("CreationDate", "xmp:CreateDate"), ("ModDate", "xmp:ModifyDate"), ("Creator", "xmp:CreatorTool"), ("Producer", "pdf:Producer"),
)
TIMES = (("creationdate", "moddate"), ("created", "modified"))


def _about(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("originaldocumentid")), "; it names the document from which this one was made").when(F.contains(low, F.lit("derivedfrom")), "; it names a document from which this one derives").otherwise("")


def undisclosed(fields: DataFrame, units: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Content values that the document's text does not show; files whose text was not read (unread: their keys) are left out."""
    content = fields.where("role = 'content'").withColumn("v", T.strip(F.col("value"))).where((F.col("v") != "") & ~F.col("v").rlike(PATH))
    if unread is not None:
        content = content.join(unread.select(*KEY), list(KEY), "left_anti")
    content = content.withColumn("low", F.lower("v"))
    df = content.join(sought.present(content.where(F.length("v") >= SHORTEST), units), [*KEY, "low"], "left_anti")
    summary = F.concat(F.lit("field "), "name", F.lit(" of "), "part", F.lit(" holds a value that the document's text shows nowhere"), _about(F.col("name")))
    return findings(df, "metadata", "undisclosed-metadata", SELF_REPORTED, summary, F.col("v"), seq=F.col("seq"))


def paths(fields: DataFrame) -> DataFrame:
    df = fields.where("role <> 'tool'").withColumn("v", T.strip(F.col("value"))).where(F.col("v").rlike(PATH))
    summary = F.concat(F.lit("field "), "name", F.lit(" of "), "part", F.lit(" holds a file system path, which names folders and mostly an account"))
    return findings(df, "metadata", "metadata-path", SELF_REPORTED, summary, F.col("v"), seq=F.col("seq") + (1 << 32))


def instant(value: Column) -> Column:
    """An ISO time as microseconds since 1970; a time without a zone counts as UTC; null if it is none."""
    iso = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?(Z|[+-]\d{2}:?\d{2})?$", 0)
    stamp = F.regexp_replace(iso, " ", "T")
    zoned = F.when(stamp.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), stamp).when(stamp.rlike("T"), F.concat(stamp, F.lit("Z"))).otherwise(F.concat(F.substring(stamp, 1, 10), F.lit("T00:00:00Z")))
    return F.when(iso != "", F.unix_micros(F.try_to_timestamp(zoned)))


def time_conflicts(fields: DataFrame) -> DataFrame:
    """Modified before created; of fields with one name the last counts."""
    times = fields.where("role = 'time'").withColumn("low", F.lower("name"))
    last = times.groupBy(*KEY, "low").agg(F.max_by(F.struct("name", "value"), "seq").alias("f"))
    parts = []
    for i, (made, changed) in enumerate(TIMES):
        a = last.where(F.col("low") == made).select(*KEY, F.col("f").alias("made"))
        b = last.where(F.col("low") == changed).select(*KEY, F.col("f").alias("changed"))
        df = a.join(b, list(KEY)).where(instant(F.col("changed.value")) < instant(F.col("made.value")))
        summary = F.concat(F.lit("by its own account the file was modified at "), "changed.value", F.lit(" and created at "), "made.value", F.lit("; a clock, a time zone, a copy or an edit can do this"))
        parts.append(findings(df, "metadata", "metadata-conflict", SELF_REPORTED, summary, F.concat("changed.name", F.lit(" "), "changed.value"), seq=F.lit((2 << 32) + i)))
    return parts[0].unionByName(parts[1])


def copy_conflicts(fields: DataFrame) -> DataFrame:
    """Info dictionary and XMP packet that state one thing differently; times are compared as instants where both are times."""
    listed = F.array(*(F.struct(F.lit(i).alias("pair"), F.lit(a).alias("info"), F.lit(b).alias("xmp")) for i, (a, b) in enumerate(PAIRS)))
    pairs = F.broadcast(fields.sparkSession.range(1).select(F.inline(listed)))  # an expression: no Python worker starts for it

    def first(side: DataFrame, name: str, out: str) -> DataFrame:
        return side.join(pairs, F.col("name") == F.col(name)).groupBy(*KEY, "pair", "info", "xmp").agg(F.min_by(F.struct("value", "role"), "seq").alias(out))

    here = first(fields.where("part = '/Info'"), "info", "here")
    there = first(fields.where("part = 'XMP'"), "xmp", "there")
    df = here.join(there, [*KEY, "pair", "info", "xmp"]).where("here.role <> 'tool' and there.role <> 'tool'")
    a, b = T.strip(F.col("here.value")), T.strip(F.col("there.value"))
    same_time = F.coalesce(instant(a) == instant(b), F.lit(False))
    df = df.where((a != b) & ~same_time)
    summary = F.concat(F.lit("the Info dictionary gives "), "info", F.lit(' as "'), "here.value", F.lit('", the XMP packet gives '), "xmp", F.lit(' as "'), "there.value", F.lit('"; a tool that clears one of the two leaves this'))
    return findings(df, "metadata", "metadata-conflict", SELF_REPORTED, summary, F.col("there.value"), seq=F.lit(3 << 32) + F.col("pair"))


def described(df: DataFrame) -> Column:
    """An event in words: what was done, with what, when, to what part."""
    return F.concat(
        F.coalesce("action", F.lit("an event")), F.coalesce(F.concat(F.lit(" by "), "software"), F.lit("")), F.coalesce(F.concat(F.lit(" at "), "when"), F.lit("")), F.coalesce(F.concat(F.lit(" (changed "), "changed", F.lit(")")), F.lit("")),
    )


def edit_trail(history: DataFrame) -> DataFrame:
    """One row a file with XMP history: the software named, each once, in order; else the events."""
    events = history.withColumn("event", described(history)).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda e: e["event"]).alias("events"))
    tools = history.where("software is not null and software <> ''").groupBy(*KEY, "software").agg(F.min("seq").alias("at"))
    tools = tools.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "software"))), lambda t: t["software"]).alias("tools"))
    df = events.join(tools, list(KEY), "left")
    summary = F.concat(F.lit("the XMP packet records "), T.plural(F.size("events"), "event"), F.lit(": "), F.array_join("events", "; "))
    return findings(df, "metadata", "revision-history", SELF_REPORTED, summary, F.coalesce(F.array_join("tools", ", "), F.array_join("events", "; ")), seq=4 << 32)


def claims(fields: DataFrame) -> DataFrame:
    """remarks(file_id, inside, seq, text): what a file says made it, when, and what it counts."""

    def of(role: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", F.concat("name", F.lit(" "), "value").alias("t")))))
        return F.array_join(F.transform(listed, lambda x: x["t"]), "; ")

    df = fields.groupBy(*KEY).agg(*(of(r).alias(r) for r in ("tool", "time", "count")))
    part = lambda c, lead: F.when(F.col(c) != "", F.concat(F.lit(lead), c))
    said = F.concat_ws(", and ", part("tool", "says it was made by "), part("time", "dates itself "), part("count", "counts "))
    return df.withColumn("said", said).where("said <> ''").select(*KEY, F.lit(0).cast("long").alias("seq"), F.concat(F.lit("the file "), "said").alias("text"))


def stale_thumbnail(images: DataFrame) -> DataFrame:
    """A preview of another shape than the picture: their aspects differ by over TOLERANCE."""
    sized = images.where("w > 0 and h > 0 and tw > 0 and th > 0")
    a, b = F.col("w") / F.col("h"), F.col("tw") / F.col("th")
    df = sized.where(F.abs(a - b) / a > TOLERANCE)
    size = lambda x, y: F.concat(F.col(x).cast("string"), F.lit("x"), F.col(y).cast("string"))
    summary = F.concat(F.lit("the picture is "), size("w", "h"), F.lit(" and the preview inside it "), size("tw", "th"), F.lit("; another shape, so it was made from another picture"))
    return findings(df, "thumbnail", "stale-thumbnail", CIRCUMSTANTIAL, summary, F.concat(F.lit("a preview "), size("tw", "th"), F.lit(", of something else")), F.concat(F.lit("a picture "), size("w", "h")))


def detect(fields: DataFrame, history: DataFrame, units: DataFrame, unread: DataFrame | None = None) -> list[DataFrame]:
    return [undisclosed(fields, units, unread), paths(fields), time_conflicts(fields), copy_conflicts(fields), edit_trail(history)]
