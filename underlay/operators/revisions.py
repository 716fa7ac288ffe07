"""Detectors 20 to 22 of office files, 3b of Word 97, and 26 and 27: text that editing left behind.

Input: revisions(file_id, inside, seq, kind, text, author, date, part), comments(.., seq, text,
author, date, initials), word_hidden(.., seq, part, text), attachments(.., att_no, name, size,
text, part, data, description), earlier(.., number, ends_at, pages, text) and units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import DIRECT, KEY, SELF_REPORTED, findings

BODY = "word/document.xml"


def _given(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.col(c))


def _by() -> Column:
    return F.concat(F.coalesce(_given("author"), F.lit("an author the file does not give")), F.coalesce(F.concat(F.lit(" on "), _given("date")), F.lit(", at a time the file does not give")))


def deleted_text(revisions: DataFrame) -> DataFrame:
    df = revisions.where(F.col("kind").isin("deletion", "move-from") & ~T.blank(F.col("text")))
    where = F.when(F.col("part") == BODY, "").otherwise(F.concat(F.lit(", in "), "part"))
    how = F.when(F.col("kind") == "deletion", " deleted by ").otherwise(" moved away by ")
    return findings(df, "revisions", "deleted-text", DIRECT, F.concat(T.characters(F.col("text")), how, _by(), where, F.lit("; the file still holds the text")), F.col("text"), seq=F.col("seq"))


def comments(notes: DataFrame) -> DataFrame:
    df = notes.where(~T.blank(F.col("text")))
    return findings(df, "revisions", "comment", DIRECT, F.concat(F.lit("a comment by "), _by(), F.lit(", in the file and not in the document's body")), F.col("text"), seq=F.col("seq") + (1 << 40))


def revision_history(revisions: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a file that names anybody: changes by kind, people in the order in which they appear, first and last date."""
    both = revisions.select(*KEY, F.lit(0).alias("of"), "seq", "kind", "author", "date").unionByName(notes.select(*KEY, F.lit(1).alias("of"), "seq", F.lit("comment").alias("kind"), "author", "date"))
    kinds = both.groupBy(*KEY, "kind").agg(F.count("*").alias("n"))
    tally = kinds.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(k["n"].cast("string"), F.lit(" "), k["kind"], F.when(k["n"] == 1, "").otherwise("s"))), ", ").alias("tally"))
    people = both.where(_given("author").isNotNull()).groupBy(*KEY, "author").agg(F.min(F.struct("of", "seq")).alias("at"))
    people = people.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "author"))), lambda p: p["author"]).alias("people"))
    dates = both.groupBy(*KEY).agg(F.min(_given("date")).alias("since"), F.max(_given("date")).alias("until"))
    df = people.join(tally, list(KEY)).join(dates, list(KEY))
    when = F.when(F.col("since").isNull(), "").when(F.col("since") == F.col("until"), F.concat(F.lit(", on "), "since")).otherwise(F.concat(F.lit(", between "), "since", F.lit(" and "), "until"))
    n = F.size("people")
    summary = F.concat(F.lit("the file records changes by "), n.cast("string"), F.when(n == 1, " person: ").otherwise(" people: "), "tally", when)
    return findings(df, "revisions", "revision-history", SELF_REPORTED, summary, F.array_join("people", ", "), seq=1 << 41)


def word_hidden(hidden: DataFrame) -> DataFrame:
    where = F.when(F.col("part") == "the document", "").otherwise(F.concat(F.lit(", in "), "part"))
    summary = F.concat(T.characters(F.col("text")), F.lit(" with Word's hidden attribute"), where, F.lit("; no screen and no print shows them"))
    return findings(hidden, "word", "invisible-text", DIRECT, summary, F.col("text"), seq=F.col("seq"))


def attached_files(attachments: DataFrame) -> DataFrame:
    slashless = lambda c: F.rtrim(F.col(c), F.lit("/"))
    where = F.when((F.col("part") != "") & (slashless("part") != slashless("name")), F.concat(F.lit(" in "), "part")).otherwise("")
    listed = F.startswith(F.col("part"), F.lit("/Names"))
    what = F.when(listed, "on no page and in no print").otherwise("of which the page shows a picture and not the file")
    summary = F.concat(F.lit('the document carries a file named "'), "name", F.lit('"'), where, F.lit(", "), T.plural(F.col("size"), "byte"), F.lit(", "), what)
    return findings(attachments, "attached", "attached-file", DIRECT, summary, F.coalesce("text", "description"), F.when(listed, "").otherwise("a rendering of it"), seq=F.col("att_no"))


def _squashed(df: DataFrame, *keep: str) -> DataFrame:
    """One row a line that is not blank, its white space collapsed, with its place."""
    return df.select(*KEY, *keep, F.posexplode(T.lines(F.col("text"))).alias("at", "raw")).select(*KEY, *keep, "at", T.squash(F.col("raw")).alias("line")).where("line <> ''")


def earlier_revisions(earlier: DataFrame, units: DataFrame) -> DataFrame:
    """Lines of an earlier revision that the document no longer shows, in order, repeats kept."""
    # Lines are compared by 128 bits of hash, so that no text but the earlier revision's moves.
    name = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    shown = _squashed(units).select(*KEY, *name).distinct()
    dropped = _squashed(earlier, "number", "ends_at", "pages").select("*", *name).join(shown, [*KEY, "h1", "h2"], "left_anti")
    df = dropped.groupBy(*KEY, "number", "ends_at", "pages").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda c: c["line"]), "\n").alias("gone"))
    total = earlier.groupBy(*KEY).agg((F.count("*") + 1).alias("total"))
    df = df.join(total, list(KEY))
    summary = F.concat(F.lit("the file holds "), F.col("total").cast("string"), F.lit(" revisions of itself; revision "), F.col("number").cast("string"), F.lit(" ("), T.plural(F.col("pages"), "page"), F.lit(", ending at byte "), F.col("ends_at").cast("string"), F.lit(") still holds text that no page shows now"))
    return findings(df, "earlier", "earlier-revision", DIRECT, summary, F.col("gone"), seq=F.col("number"))
