"""Operator 11, filter interaction audit: inclusion-exclusion over all filter intersections.

Five filters stand in some order; what each one removes depends on those before it.
No order is run.  For every set S of filters the product of its members' failure
flags is summed over the documents of a part: J(S), the joint failures, 32 numbers a
part (J of no filter is the part's size), each also summed over good and over toxic
documents.  Everything else follows from them:

- survivors of a set P: the Möbius sum of (-1)^|S| J(S) over subsets S of P;
- removed at a step: survivors before it less survivors after it;
- redundant: J of the filter alone less what it removed; unique failures: survivors
  of the four others less survivors of all;
- Shapley: what a set removes is a game whose Harsanyi dividends are
  (-1)^(|S|+1) J(S), each shared equally by S; times 120, the sum over all orders.

Filter E (a copy of a smaller id's text) is table-wide.  Texts are told by SHA-256,
so only thin rows are shuffled: equal rows are summed first, the smallest id of each
digest is a map-side minimum, and it is met by (id, digest), so neither a group of
copies nor an id that fills a third of the table lands in one task.

Cases: a null or empty text has no words (fails A alone, and E as a copy of another
empty one); a null id has no label, is smaller than none and larger than none, so it
never fails E; repeated rows are documents each, and rows of one id are no copies of
one another; several labels of one id: it is good (toxic) if any says so; a null
source is the empty string; a very long text is read whole; an empty table gives no
rows; extra columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """Failure flags of the filters that a text decides alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    of_words = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": of_words["n"] < LEAST_WORDS,
        "B": of_words["distinct"] * 100 < of_words["n"] * DISTINCT_PERCENT,
        "C": upper.cast("long") * 100 > F.length(text).cast("long") * UPPER_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def with_copies(docs: DataFrame, name: str = "E") -> DataFrame:
    """docs (id, digest, more columns) summed to rows of n equal documents, with a flag: a smaller id holds the same digest."""
    rows = stored(docs.groupBy(*docs.columns).agg(F.count("*").alias("n")), "audit")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    return rows.join(first, ["id", "digest"], "left").withColumn(name, F.col("id").isNotNull() & F.col("first").isNull()).drop("first")


def _sets(n: int) -> range:
    """All sets of n filters; bit i stands for filter i."""
    return range(1 << n)


def joint_failures(rows: DataFrame, filters: str, weights: Mapping[str, str], part: str = "part") -> DataFrame:
    """A row a part: for each weight (SQL) an array over all sets of filters of the weight's sum where all of the set fail."""
    product = lambda s: " * ".join(["1", *(f"int({f})" for i, f in enumerate(filters) if s >> i & 1)])
    sums = rows.groupBy(part).agg(*(F.expr(f"sum({w} * {product(s)}) AS {name}{s}") for name, w in weights.items() for s in _sets(len(filters))))
    return sums.select(part, *(F.array(*(f"{name}{s}" for s in _sets(len(filters)))).alias(name) for name in weights))


def survivors(joint: str, n: int) -> Column:
    """For every set of filters, the weight that passes all of them: the Möbius sum over its subsets."""
    signed = lambda p: " ".join(f"{'-' if s.bit_count() % 2 else '+'} {joint}[{s}]" for s in _sets(n) if s & ~p == 0)
    return F.expr(f"array({', '.join(map(signed, _sets(n)))})")


def shapley(joint: str, n: int, orders: int) -> Column:
    """For every filter, its Shapley value times the number of orders: the dividends of the sets that hold it, shared equally."""
    dividend = lambda s: f"{'+' if s.bit_count() % 2 else '-'} {joint}[{s}] * {orders // s.bit_count()}L"
    return F.expr(f"array({', '.join(' '.join(dividend(s) for s in _sets(n) if s >> i & 1) for i in range(n))})")


def audit(rows: DataFrame, filters: str, n: str = "n", good: str = "good", toxic: str = "toxic", part: str = "part") -> DataFrame:
    """A row a part, order of the filters and step.  rows: part, a flag a filter, n equal documents, and flags good and toxic."""
    k = len(filters)
    weights = {"docs": n, "goods": f"{n} * int({good})", "toxics": f"{n} * int({toxic})"}
    joint = joint_failures(rows.withColumnRenamed(part, "part"), filters, weights)
    orders = ["".join(p) for p in permutations(filters)]
    left = joint.select("part", "docs", shapley("docs", k, len(orders)).alias("shares"), *(survivors(w, k).alias(f"{w}_left") for w in weights))
    bits = [sum(1 << filters.index(g) for g in o[:i]) for o in orders for i in range(k)]
    steps = [{"filter_order": o, "step": i + 1, "filter": filters.index(o[i]), "before": bits[j * k + i]} for j, o in enumerate(orders) for i in range(k)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    laid = left.select("*", F.inline(steps)).withColumn("bit", F.pow(F.lit(2), "filter").cast("int"))
    every = (1 << k) - 1
    gone = lambda w: F.get(f"{w}_left", F.col("before")) - F.get(f"{w}_left", F.col("before") + F.col("bit"))
    return laid.select(
        "part",
        "filter_order",
        "step",
        F.get("docs_left", F.col("before") + F.col("bit")).alias("kept"),
        gone("docs").alias("removed"),
        (F.get("docs", F.col("bit")) - gone("docs")).alias("redundant"),
        (F.get("docs_left", F.lit(every) - F.col("bit")) - F.get("docs_left", F.lit(every))).alias("unique_fails"),
        gone("goods").alias("good_lost"),
        gone("toxics").alias("toxic_lost"),
        F.get("shares", F.col("filter")).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(f.alias(name) for name, f in text_flags(text).items()))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = with_copies(docs).join(marks, "id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})
    return audit(rows, "ABCDE")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (SELECT x, min(doc_id) AS first FROM d GROUP BY x),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(x) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(x, '{SYMBOLS}') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS failed,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN m USING (x) LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS goods, count(*) FILTER (WHERE toxic) AS toxics FROM f GROUP BY part, failed),
c(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, filter, failed, n, goods, toxics, contains(failed, filter) AS fails, len(translate(failed, before, '')) < len(failed) AS earlier FROM g, s),
t AS (SELECT part, filter_order, step, filter, sum(CASE WHEN fails OR earlier THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT earlier THEN goods ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxics ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t
"""
