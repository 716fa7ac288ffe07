"""Operator 6, PII: patterns, and terms that disclose what the patterns found (native Spark).

E-mail and IP addresses, card and telephone numbers are the protected entities.
Around each entity the corpus is read for terms: a term and an entity meet once
for every distinct window that holds both.  A window reaches REACH code points to
both sides of the entity, over the ends of its line into the lines beside it; copies
of one count once.  For terms that meet one entity at least SUPPORT times, the
distinct lines of the whole corpus that hold the term are counted; before that, of
one line in SAMPLE by hash, and a term that those alone put below a threshold is left
out.  No term that would reach it is.
A term t discloses an entity e if P(e|t) = c(t,e) / c(t), at most 1, reaches
DISCLOSURE and the information gained, log2 of P(e|t) / P(e), reaches BITS (P(e) is
the share of the corpus's lines that hold windows of e).  Every occurrence of such
a term is a span too; sanitised() generalises entities to their kind and removes
disclosing terms.

Positions come from the pieces between the matches: split() and
regexp_extract_all() see the same matches, so running sums of lengths are offsets.
The sums are taken BLOCK pieces at a time, so a text of many matches costs in
proportion to them.  The patterns are written with possessive quantifiers and start
only where a leftmost match can start; they find the same matches and stay linear on
long runs.

Cases: a null or empty text has no spans; repeated rows give equal results; a
text of one kind of sign, of any length, is read once; spans that start alike are
ordered by kind; null ids stand for themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table

REACH = 120
SUPPORT = 3
DISCLOSURE = 0.5
BITS = 4.0
BROADCAST_TERMS = 200_000
BLOCK = 64
#: One in so many distinct lines is counted first.
SAMPLE = 16
#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_WORD = "[^" + WORD[2:-1]
#: A text's pieces: up to 2,048 code points that end where no word goes on, or else one long word.
PIECE = rf"(?s).{{1,2048}}(?!{_IN_WORD})|.{_IN_WORD}*+"
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))

    def value(i: Column) -> Column:
        v = F.substring(d, i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(x)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def running(sizes: Column) -> Column:
    """Of each of the sizes, the sum of those before it."""

    def sums(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: x + at)))

    def cut(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: sums(F.slice(s, i + 1, F.lit(BLOCK))))

    return _let(sizes, lambda s: _let(cut(s), joined))


def spans_of(text: Column, kind: str) -> Column:
    """Sorted spans of one kind in a text that is not null."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    zipped = _let(matches, lambda m: F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda b, x: F.struct(F.length(b).alias("b"), F.length(x).alias("n"), _valid(kind, x).alias("ok"))))

    def placed(z: Column) -> Column:
        starts = running(F.transform(z, lambda x: x["b"] + x["n"]))
        return F.filter(F.zip_with(z, starts, lambda x, at: F.when(x["ok"], _span(at + x["b"], at + x["b"] + x["n"], kind))), lambda s: s.isNotNull())

    some = text.rlike(PATTERNS[kind])
    if kind in ("email", "phone"):
        some = F.contains(text, F.lit("@" if kind == "email" else "+")) & some
    return F.when(some, _let(zipped, placed)).otherwise(_no_spans())


def base_spans(text: Column) -> Column:
    """Spans of all patterns by start, then kind."""
    return F.sort_array(F.concat(*(spans_of(text, k) for k in PATTERNS)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _may_hold(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in (PATTERNS["ip"], PATTERNS["card"], PATTERNS["phone"]))) | (F.contains(text, F.lit("@")) & text.rlike(PATTERNS["email"]))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda w: (F.length(w) >= 3) & w.rlike("[^0-9]"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def held_by(text: DataFrame, terms: DataFrame, n: int, one_in: int = 1) -> DataFrame:
    """Of each of the n terms, the distinct lines that hold it: of all lines, or of those whose hash one_in divides."""
    lines = text.select(F.explode_outer(F.split("text", "\n", -1)).alias("line")).select(F.xxhash64("line").alias("of"), "line")
    if one_in > 1:
        lines = lines.where(F.pmod("of", F.lit(one_in)) == 0)
    words = lines.select("of", F.explode_outer(_terms(F.col("line"))).alias("term"))
    return _small(words.join(_small(terms, n), "term").distinct().groupBy("term").agg(F.count("*").alias("held")), n)


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """term, entity, met (c(t,e)), held (c(t)), disclosure and bits of all terms over the thresholds."""
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    # A line with what is near of the lines beside it.
    beside = lambda x, i, lines: F.struct(F.right(F.coalesce(F.get(lines, i - 1), F.lit("")), F.lit(REACH)).alias("above"), x.alias("line"), F.substring(F.coalesce(F.get(lines, i + 1), F.lit("")), 1, REACH).alias("below"))
    triples = _let(F.split("text", "\n", -1), lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(_may_hold(x), beside(x, i, lines))), lambda t: t.isNotNull()))
    lines = text.where(_may_hold(F.col("text"))).select(F.inline(triples))

    def window(s: Column) -> Column:
        before = F.concat_ws(" ", F.col("above"), F.substring("line", F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH))))
        after = F.concat_ws(" ", F.substring("line", s["end"] + 1, F.lit(REACH)), F.col("below"))
        entity = F.concat(s["kind"], F.lit(":"), F.substring("line", s["start"] + 1, s["end"] - s["start"]))
        return F.struct(entity.alias("entity"), F.concat_ws(" ", F.right(before, F.lit(REACH)), F.substring(after, 1, REACH)).alias("around"))

    spans = lines.select("above", "line", "below", base_spans(F.col("line")).alias("spans"))
    near = spans.select(F.inline(F.transform("spans", window))).distinct().select("entity", "around", F.xxhash64("entity", "around").alias("of"))
    near = keep(near)
    met = near.select("of", "entity", F.explode(_terms(F.col("around"))).alias("term")).distinct().groupBy("term", "entity").agg(F.count("*").alias("met")).where(F.col("met") >= support)
    met = keep(met)
    terms = keep(met.select("term").distinct())
    n = terms.count()
    empty = met.where(F.lit(False)).select("term", "entity", "met", F.lit(0).cast("long").alias("held"), F.lit(0.0).alias("disclosure"), F.lit(0.0).alias("bits"))
    if not n:
        return empty
    total = text.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    of_entity = near.select("entity", "of").distinct().groupBy("entity").agg(F.count("*").alias("lines"))

    def rated(pairs: DataFrame, held: DataFrame, how: str) -> DataFrame:
        r = pairs.join(held, "term", how).withColumn("disclosure", F.least(F.col("met") / F.greatest(F.coalesce("held", F.lit(0)), F.lit(1)), F.lit(1.0)))
        r = r.withColumn("bits", F.log2(F.col("disclosure") * F.lit(float(total)) / F.col("lines")))
        return r.where((F.col("disclosure") >= disclosure) & (F.col("bits") >= bits))

    # Some of the lines hold a term at most as often as all do, so what they rate too low is too low; frequent words go here.
    likely = keep(rated(met.join(of_entity, "entity"), held_by(text, terms, n, SAMPLE), "left").select("term", "entity", "met", "lines"))
    terms = keep(likely.select("term").distinct())
    n = terms.count()
    if not n:
        return empty
    return keep(rated(likely, held_by(text, terms, n), "inner").select("term", "entity", "met", "held", "disclosure", "bits"))


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """doc, of (hash of the text) and the spans of disclosing terms; None if there are no such terms."""
    terms = keep(terms.select("term").distinct())
    n = terms.count()
    if not n:
        return None
    # Positions are summed up within pieces of bounded length, and only for words that are terms.
    pieces = _let(F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0)), lambda p: F.zip_with(p, running(F.transform(p, F.length)), lambda x, at: F.struct(x.alias("piece"), at.alias("at"))))
    cut = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("of"), F.inline(pieces))
    worded = cut.select("doc", "of", "at", F.split("piece", WORD, -1).alias("gaps"), F.regexp_extract_all("piece", F.lit(WORD), F.lit(0)).alias("words"))
    placed = worded.select("*", F.posexplode_outer("words").alias("i", "word")).where(F.col("word").isNotNull()).withColumn("term", F.lower("word"))

    def lengths(c: str, k: Column) -> Column:
        return F.aggregate(F.slice(F.col(c), F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))

    start = F.col("at") + lengths("gaps", F.col("i") + 1) + lengths("words", F.col("i"))
    spans = placed.join(_small(terms, n), "term").select("doc", "of", _span(start, start + F.length("word"), "term").alias("s"))
    return spans.groupBy("doc", "of").agg(F.collect_set("s").alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """docs' id and text columns, base and spans: arrays of (start, rank, end, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    terms = term_spans(docs, disclosing_terms(docs, text_col, support, disclosure, bits), id_col, text_col)
    based = docs.select(id_col, text_col, base_spans(text).alias("base"))
    if terms is None:
        return based.withColumn("spans", F.col("base"))
    doc = F.col(id_col)
    joined = based.join(terms.hint("shuffle_hash"), doc.eqNullSafe(F.col("doc")) & (F.xxhash64(text_col) == F.col("of")), "left")
    apart = F.filter(F.coalesce("terms", _no_spans()), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select(id_col, text_col, "base", F.sort_array(F.concat("base", apart)).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and disclosing terms removed; overlapping spans go as one."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    def put(k: Column) -> Column:
        """What is kept before a span, and what stands for it."""
        mark = F.when(k["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(k["kind"]), F.lit("]")))
        return F.concat(F.substring(text, k["start"] + 1, k["end"] - k["start"]), mark)

    return _let(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(F.transform(a["out"], put), ""), F.substring(text, a["at"] + 1, F.length(text))))


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in PATTERNS]
    clean = F.sha2(sanitised(F.coalesce("text", F.lit("")), F.col("spans")), 256).alias("sanitised_sha256")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), clean)
