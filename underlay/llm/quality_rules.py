"""Operator 12, quality rules: lines first, then documents (native Spark).

Every line with a word is judged by itself.  Rules, the first that fails names the line:

- boilerplate: a short line with legal, cookie or template wording;
- navigation: a short line of links (two or more separators, or a link's wording alone);
- symbols: one or more of `#*$%&|<>` for every SYMBOL_WORDS words;
- punctuation: a short line that no terminal mark ends.

Lines that fail go; the others stay, joined as they were.  A document is rejected if
the lines left hold less than KEPT_PERCENT of its word characters, or if it fails the
base: too few words, or too many of them in repeated windows of three words.

All of it is one pass over a row's own arrays, with no shuffle: windows are sorted by
hash, then by their words, so that equal ones are neighbours and a hash never decides
alone.

Cases: a null or empty text has no words, loses no line and fails the base; a line
without words is no copy of another and never fails; repeated rows and null ids are
rows like others; a very long text costs a sort of its windows; there are no ties; an
empty table gives an empty result; extra columns are carried only where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
KEPT_PERCENT = 50
SYMBOL_WORDS = 8
RULES = ("boilerplate", "navigation", "symbols", "punctuation")
#: Most words of a line that the rule judges.
SHORT = {"boilerplate": 30, "navigation": 20, "punctuation": 8}
#: Wording of templates, and of links that stand alone on a line.
BOILERPLATE = r"(?i)(all rights reserved|copyright (\(c\)|©|[0-9]{4})|terms of (use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|lorem ipsum|subscribe to our|powered by)"
LINKS = r"(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|back|read more|log ?in|sign (in|up)|share( this)?|print|contact( us)?|about( us)?|skip to content)[\x20\x09-\x0D.:!>»]*\z"
SEPARATOR = r"[\x20\x09](\||»|›|>|·|•)[\x20\x09]"
TERMINAL = r"[.!?:;…。！？][\"'”’»)\]」』]*[\x20\x09-\x0D]*\z"


def line_rule(line: Column) -> Column:
    """The rule that a line fails, or null."""
    n = F.regexp_count(line, F.lit(WORD))
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    return (
        F.when(n == 0, F.lit(None))
        .when((n <= SHORT["boilerplate"]) & line.rlike(BOILERPLATE), F.lit("boilerplate"))
        .when((n <= SHORT["navigation"]) & ((F.regexp_count(line, F.lit(SEPARATOR)) >= 2) | line.rlike(LINKS)), F.lit("navigation"))
        .when(symbols * SYMBOL_WORDS >= F.greatest(n, F.lit(SYMBOL_WORDS)), F.lit("symbols"))
        .when((n <= SHORT["punctuation"]) & ~line.rlike(TERMINAL), F.lit("punctuation"))
    )


def _with(value: Column, use) -> Column:
    """use(value), with value computed once: as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of consecutive words that occurs twice or more."""
    count = F.greatest(F.size(words) - (window - 1), F.lit(0))
    at = lambda x, i: F.concat_ws(" ", x, *(F.get(words, i + j) for j in range(1, window)))
    windows = F.transform(F.slice(words, F.lit(1), count), at)

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i"))))
        same = lambda s, x, j: (F.get(s, j)["h"] == x["h"]) & (F.get(s, j)["x"] == x["x"])
        starts = _with(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"])))
        # A window adds the words up to the next window that repeats, its own length at most.
        return _with(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b))

    return _with(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def _is(rule: str):
    return lambda x: x == rule


def clean(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, the base's counts, base_failed, kept, kept_text, and <rule>_lines: how many each rule took."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.struct(*carry).alias("row"), text.alias("x"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), F.split(text, "\n", -1).alias("lines"))
    worded = F.filter("lines", lambda x: x.rlike(WORD))
    judged = read.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("x", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("x", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _with(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), line_rule(x).alias("rule"))).alias("judged"),
    )
    kept = F.array_join(F.transform(F.filter("judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    taken = {r: F.size(F.filter(F.transform("judged", lambda x: x["rule"]), _is(r))).cast("long").alias(f"{r}_lines") for r in RULES}
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lined = judged.select("row", *counts, kept.alias("kept_text"), *taken.values())
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    left = F.length(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", "")).cast("long")
    return lined.select("row.*", *counts, failed.alias("base_failed"), (~failed & (left * 100 >= F.col("word_chars") * KEPT_PERCENT)).alias("kept"), "kept_text", *(f"{r}_lines" for r in taken))


def query(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.sha2("kept_text", 256).alias("kept_sha256"))


_N = f"len(regexp_extract_all(x, '{WORD}'))"
_BOIL, _LINK, _END = (p.replace("'", "''") for p in (BOILERPLATE, LINKS, TERMINAL))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM p, (SELECT unnest(range({WINDOW})) AS j) GROUP BY r),
j AS (SELECT r, k, x, CASE WHEN {_N} = 0 THEN NULL
  WHEN {_N} <= {SHORT["boilerplate"]} AND regexp_matches(x, '{_BOIL}') THEN 'boilerplate'
  WHEN {_N} <= {SHORT["navigation"]} AND (len(regexp_extract_all(x, '{SEPARATOR}')) >= 2 OR regexp_matches(x, '{_LINK}')) THEN 'navigation'
  WHEN length(regexp_replace(x, '[^{SYMBOLS}]', '', 'g')) * {SYMBOL_WORDS} >= greatest({_N}, {SYMBOL_WORDS}) THEN 'symbols'
  WHEN {_N} <= {SHORT["punctuation"]} AND NOT regexp_matches(x, '{_END}') THEN 'punctuation' END AS rule
  FROM (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) AS k FROM d)),
k AS (SELECT r, string_agg(x, chr(10) ORDER BY k) AS kept_text FROM j WHERE rule IS NULL GROUP BY r),
b AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(lines, lambda y: regexp_matches(y, '{WORD}'))) - len(list_distinct(list_filter(lines, lambda y: regexp_matches(y, '{WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(kept_text, '') AS kept_text FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN k ON k.r = d.r),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * length(regexp_replace(kept_text, '[\x20\x09-\x0D]', '', 'g')) >= {KEPT_PERCENT} * word_chars AS kept, sha256(kept_text) AS kept_sha256 FROM f
"""
