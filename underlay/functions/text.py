"""Column expressions over text: code points, labels, blanks, lines and the explicit character ranges."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "⟨", "⟩"

# Character sets and ranges of the detectors' definitions.
ZERO_WIDTH = (0x00AD, 0x115F, 0x1160, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0)
EMBEDDINGS, POP = (0x202A, 0x202B, 0x202D, 0x202E), 0x202C
ISOLATES, POP_ISOLATE = (0x2066, 0x2067, 0x2068), 0x2069
MARKS = (0x200E, 0x200F)
BIDI = (*EMBEDDINGS, POP, *ISOLATES, POP_ISOLATE, *MARKS)
OVERRIDE = 0x202E
TAGS = (0xE0000, 0xE007F)
JOINING = ((0x0600, 0x07FF), (0x0840, 0x085F), (0x08A0, 0x08FF), (0x0900, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))
PICTOGRAPHIC = (
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23FA),
    (0x24C2, 0x24C2), (0x25AA, 0x25FE), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3299), (0xFE0E, 0xFE0F), (0x1F000, 0x1FAFF), (0xE0020, 0xE007F),
)
SCRIPTS = {
    "Latin": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x0530, 0x058F),),
    "Hebrew": ((0x0590, 0x05FF),),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)),
    "Syriac": ((0x0700, 0x074F),),
    "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Cherokee": ((0x13A0, 0x13FF),),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Hiragana": ((0x3040, 0x309F),),
    "Katakana": ((0x30A0, 0x30FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
EXPECTED_MIX = ("Han", "Hangul", "Hiragana", "Katakana", "Latin")
#: Python's line ends; a carriage return before a line feed is half of one.
LINE_ENDS = (0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
#: Python's white space, which is wider than trim() and narrower than (?U)\\s in places.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def char_class(points=(), ranges=()) -> str:
    """A regex class of code points and ranges.  Those beyond U+FFFF stand as themselves: a lookbehind only then allows for their two units."""
    one = lambda p: chr(p) if p > 0xFFFF else f"\\x{{{p:X}}}"
    return "[" + "".join(map(one, points)) + "".join(f"{one(a)}-{one(b)}" for a, b in ranges) + "]"


def within(cp: Column, ranges) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | (cp == a if a == b else cp.between(a, b))
    return out


def label(cp: Column) -> Column:
    """U+XXXX, with at least four digits."""
    h = F.hex(cp.cast("long"))
    return F.concat(F.lit("U+"), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h))


def char_name(cp: Column) -> Column:
    known = [x for p in (*ZERO_WIDTH, *BIDI) for x in (F.lit(p), F.lit(unicodedata.name(chr(p))))]
    return F.coalesce(F.element_at(F.create_map(*known), cp), label(cp))


def script(ch: Column, cp: Column) -> Column:
    """A letter's script; null for other characters and other scripts."""
    out = None
    for name, ranges in SCRIPTS.items():
        hit = within(cp, ranges)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(ch.rlike(r"\p{L}"), out)


def blank(text: Column) -> Column:
    """Nothing but Python's white space; null is blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "") == ""


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def squash(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def lines(text: Column) -> Column:
    """Python's lines without their ends; no empty line after a last line end."""
    ends = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
    parts = F.split(text, ends, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _alphanumeric(text: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


#: ASCII characters that are no letters or digits, and those that are, in lower case.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
_MARKS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())


def alphanumeric(text: Column) -> Column:
    """Lower-cased letters and digits.  A pattern costs a word ten times what it costs to drop ASCII marks, so it is for other scripts."""
    low = F.translate(F.lower(text), _MARKS, "")
    return F.when(F.translate(low, _PLAIN, "") == "", low).otherwise(_alphanumeric(text))


@functools.cache
def known_letters(spark: SparkSession) -> tuple[str, dict[int, str]]:
    """All letters and digits that alphanumeric() keeps, and the characters whose lower case Spark knows and Python does not, or another:
    the JVM and Spark go by versions of Unicode of their own."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = spark.range(1, 0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).select("id", c.alias("c"), F.lower(c).alias("low"), c.rlike(r"^[\p{L}\p{N}]").alias("kept"))
    found = rows.where("kept or low <> c").collect()
    low = {r.id: r.low for r in found}
    theirs = {p: chr(p) for p in range(0x110000) if chr(p).lower() != chr(p) and p not in low}
    return "".join(r.c for r in found if r.kept), theirs | {p: x for p, x in low.items() if chr(p).lower() != x}


def letters(text: str, known: frozenset[str], low: dict[int, str]) -> str:
    """alphanumeric() of one text, where it lies already."""
    return "".join(c for c in (text if text.isascii() else text.translate(low)).lower() if c in known)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def characters(text: Column) -> Column:
    return plural(F.length(text), "character")


def column_name(index: Column) -> Column:
    """A1 naming: 1 is A, 27 is AA; up to three letters."""

    def letter(x: Column) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (x % 26 + 1).cast("int"), F.lit(1))

    i = index.cast("int") - 1
    one = letter(i)
    two = letter(F.floor(i / 26) - 1)
    three = letter(F.floor((F.floor(i / 26) - 1) / 26) - 1)
    return F.when(i < 0, "").when(i < 26, one).when(i < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))
