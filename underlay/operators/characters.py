"""Detectors 8 to 11: zero-width and bidi characters, tag characters, words of mixed scripts.

Input: units(file_id, inside, unit_no, page, text).  A pattern decides which units
and then which lines hold a candidate; only those lines become rows, never their
characters.  A line is cut by its detector's pattern into runs of hits and what
lies between, so marking, stripping and reversing are joins of those parts, and
columns are sums of their lengths.  All of this stays in the scan's stage.  Only
brackets that cross lines need more (`brackets.py`), of the control characters alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import brackets
from .brackets import AFTER_END as _AFTER_END
from .brackets import CONTROL as _CONTROL
from .brackets import UNIT
from .brackets import cut as _cut
from .findings import CIRCUMSTANTIAL, DIRECT, findings

_LINE = (*UNIT, "line")


def _lines(units: DataFrame, pattern: str) -> DataFrame:
    """The lines that match: line from 0, and body, without a carriage return or line feed at its end."""
    some = units.where(F.col("text").rlike(pattern)).select(*UNIT, "page", F.posexplode(F.split("text", _AFTER_END, -1)).alias("line", "raw"))
    return some.where(F.col("raw").rlike(pattern)).select(*_LINE, "page", F.regexp_replace("raw", r"(?:\r\n|[\r\n])\z", "").alias("body"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _labels(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: T.label(F.ascii(c)))


def _bracketed(text: Column) -> Column:
    return F.array_join(F.transform(_labels(text), lambda x: F.concat(F.lit(T.OPEN), x, F.lit(T.CLOSE))), "")


def _woven(between: Column, matches: Column, shown) -> Column:
    """The parts joined again, the matches as shown."""
    return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.concat(b, shown(m))), ""), F.element_at(between, -1))


def _places(between: Column, matches: Column) -> Column:
    """Of each match: first, its place in the line from 0; nth, the number of characters matched before it; run."""
    sized = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("run")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<first:int,nth:int,run:string>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        first, size = a["at"] + x["gap"], F.length(x["run"])
        return F.struct((first + size).alias("at"), (a["n"] + size).alias("n"), F.concat(a["out"], F.array(F.struct(first.alias("first"), a["n"].alias("nth"), x["run"].alias("run")))).alias("out"))

    return F.aggregate(sized, start, step, lambda a: a["out"])


def _runs(lines: DataFrame, pattern: str, shown, stripped=None, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each run of a line, with the line as a machine reads it (marked) and as a reader sees it (seen)."""
    between, matches = F.col("between"), F.col("matches")
    cut = lines.select("*", *(c.alias(n) for c, n in zip(_cut(F.col("body"), pattern), ("between", "matches"))))
    seen = stripped(F.col("body")) if stripped else F.array_join(between, "")
    return cut.select(*_LINE, "page", *also, _woven(between, matches, shown).alias("marked"), seen.alias("seen"), F.inline(_places(between, matches)))


def _placed(kind: int) -> dict:
    return {"page": F.col("page"), "line": F.col("line") + 1, "column": F.col("first") + 1, "seq": F.col("unit_no") * 4 + kind}


def _zero_width_runs() -> str:
    """A run of zero-width characters.  A joiner between two pictographs, or a joiner or non-joiner between two letters of a joining script, is none."""
    drawn, joining = T.char_class(ranges=T.PICTOGRAPHIC), T.char_class(ranges=T.JOINING)
    benign = rf"(?!(?<={drawn})\x{{200D}}(?={drawn}))(?!(?<={joining})[\x{{200C}}\x{{200D}}](?={joining}))"
    return f"(?:{benign}{T.char_class(T.ZERO_WIDTH)})+"


def zero_width(units: DataFrame) -> DataFrame:
    """A byte-order mark that opens the unit does not count; it stays where it is."""
    opening = (F.col("line") == 0) & F.startswith(F.col("body"), F.lit("\ufeff"))
    mark = F.when(opening, F.lit("\ufeff")).otherwise("")
    lines = _lines(units, T.char_class(T.ZERO_WIDTH)).withColumn("mark", mark).withColumn("body", F.when(opening, F.substring("body", 2, 1 << 30)).otherwise(F.col("body")))
    df = _runs(lines, _zero_width_runs(), _bracketed, also=("mark",))
    df = df.withColumn("first", F.col("first") + F.length("mark"))
    n = F.length("run")
    names = F.array_sort(F.array_distinct(F.transform(_chars(F.col("run")), lambda c: T.char_name(F.ascii(c)))))
    one = F.concat(F.element_at(names, 1), F.lit(" ("), T.label(F.ascii("run")), F.lit("), which a reader cannot see"))
    several = F.concat(n.cast("string"), F.lit(" characters a reader cannot see: "), F.array_join(names, ", "))
    shown = {"machine_reads": F.concat("mark", "marked"), "human_sees": F.concat("mark", "seen")}
    return findings(df, "characters", "zero-width", DIRECT, F.when(n == 1, one).otherwise(several), **shown, codepoints=_labels(F.col("run")), **_placed(0))


_CLOSING = T.char_class((T.POP, T.POP_ISOLATE))


def _rendered(body: Column) -> Column:
    """The line as it renders: what follows a right-to-left override reversed until it is closed, controls gone."""
    before, turned = _cut(body, rf"\x{{{T.OVERRIDE:X}}}[^{_CLOSING[1:-1]}]*")
    plain = lambda text: F.regexp_replace(text, _CONTROL, "")
    return F.concat(F.array_join(F.zip_with(F.slice(before, F.lit(1), F.size(turned)), turned, lambda b, t: F.concat(plain(b), F.reverse(plain(t)))), ""), plain(F.element_at(before, -1)))


def bidi_control(units: DataFrame) -> DataFrame:
    still = brackets.controls(units).where("open").groupBy(*_LINE).agg(F.collect_list("nth").alias("open"))
    df = _runs(_lines(units, _CONTROL), f"{_CONTROL}+", _bracketed, _rendered).join(still, list(_LINE), "left")
    names, labels = F.array_join(F.transform(_chars(F.col("run")), lambda c: T.char_name(F.ascii(c))), ", "), F.array_join(_labels(F.col("run")), ", ")
    stays = F.coalesce(F.exists("open", lambda i: (i >= F.col("nth")) & (i < F.col("nth") + F.length("run"))), F.lit(False))
    summary = F.concat(names, F.lit(" ("), labels, F.lit(")"), F.when(stays, ", never closed before the text ends").otherwise(""))
    return findings(df, "characters", "bidi-control", DIRECT, summary, F.col("marked"), F.col("seen"), codepoints=_labels(F.col("run")), **_placed(1))


def _decoded(run: Column) -> Column:
    spelled = F.filter(F.transform(_chars(run), lambda c: F.ascii(c) - T.TAGS[0]), lambda c: c.between(0x20, 0x7E))
    return F.array_join(F.transform(spelled, lambda c: F.chr(c)), "")


def tag_characters(units: DataFrame) -> DataFrame:
    """Each run of a line is replaced by its own message; text between two runs stays."""
    tags = T.char_class(ranges=[T.TAGS])

    def shown(run: Column) -> Column:
        message = _decoded(run)
        return F.when(message != "", F.concat(F.lit(f"{T.OPEN}tag characters: "), message, F.lit(T.CLOSE))).otherwise(_bracketed(run))

    df = _runs(_lines(units, tags), f"{tags}+", shown).withColumn("message", _decoded(F.col("run")))
    summary = F.concat(F.length("run").cast("string"), F.lit(" tag characters that no renderer draws"), F.when(F.col("message") == "", ", which spell nothing printable").otherwise(""))
    message = F.when(F.col("message") != "", F.col("message"))
    return findings(df, "characters", "tag-characters", DIRECT, summary, F.col("marked"), F.col("seen"), codepoints=_labels(F.col("run")), decoded=message, **_placed(2))


def _mixed(word: Column) -> Column:
    """Whether a word holds letters of two scripts, one of them not of those that are used together; by patterns alone."""
    foreign = {name: ranges for name, ranges in T.SCRIPTS.items() if name not in T.EXPECTED_MIX}
    known = [r for ranges in T.SCRIPTS.values() for r in ranges]
    letter = rf"(?:(?=\p{{L}}){T.char_class(ranges=known)})"
    alone = "|".join(rf"(?:(?!{letter}).|{T.char_class(ranges=ranges)})*+" for ranges in foreign.values())
    some = rf"(?=\p{{L}}){T.char_class(ranges=[r for ranges in foreign.values() for r in ranges])}"
    return word.rlike(some) & ~word.rlike(rf"(?s)\A(?:{alone})\z")


def mixed_script(units: DataFrame) -> DataFrame:
    """A tie for the majority goes to the script that comes first in the word."""
    foreign = T.char_class(ranges=[r for name, ranges in T.SCRIPTS.items() if name not in T.EXPECTED_MIX for r in ranges])
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,word:string>>)").alias("out"))

    def step(a: Column, word: Column) -> Column:
        out = F.when(_mixed(word), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), word.alias("word"))))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(word) + 1).alias("at"), out.alias("out"))

    found = _lines(units, foreign).select(*_LINE, "page", "body", F.inline(F.aggregate(F.split("body", " ", -1), start, step, lambda a: a["out"])))
    letters = F.transform(_chars(F.col("word")), lambda c: F.struct(c.alias("ch"), T.script(c, F.ascii(c)).alias("script")))
    found = found.withColumn("letters", letters).withColumn("of", F.transform("letters", lambda c: c["script"]))
    scripts = F.array_compact(F.array_distinct("of"))
    ranked = F.transform(scripts, lambda s: F.struct(F.size(F.filter("of", lambda x: x == s)).alias("n"), (-F.array_position("of", s)).alias("at"), s.alias("script")))
    found = found.withColumn("main", F.array_max(ranked)["script"]).withColumn("scripts", F.sort_array(scripts))
    odd = lambda c: c["script"].isNotNull() & (c["script"] != F.col("main"))
    marked = F.array_join(F.transform("letters", lambda c: F.when(odd(c), F.concat(F.lit(T.OPEN), T.label(F.ascii(c["ch"])), F.lit(" "), c["script"], F.lit(T.CLOSE))).otherwise(c["ch"])), "")
    df = found.withColumn("first", F.col("start") + F.array_position(F.transform("letters", odd), True).cast("int") - 1)
    machine = F.concat(F.substring("body", F.lit(1), F.col("start")), marked, F.substring("body", F.col("start") + F.length("word") + 1, F.length("body")))
    points = F.transform(F.filter("letters", odd), lambda c: T.label(F.ascii(c["ch"])))
    summary = F.concat(F.lit('one word, "'), F.col("word"), F.lit('", mixes '), F.array_join("scripts", " and "))
    return findings(df, "characters", "mixed-script", CIRCUMSTANTIAL, summary, machine, F.col("body"), codepoints=points, **_placed(3))


def detect(units: DataFrame) -> list[DataFrame]:
    return [zero_width(units), bidi_control(units), tag_characters(units), mixed_script(units)]
