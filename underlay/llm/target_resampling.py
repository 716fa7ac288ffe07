"""Operator 13, target-distribution importance resampling with overlap chunking.

Documents are weighed by how much likelier their hashed word n-grams are in the target
(the benchmark) than in the corpus, and drawn without replacement by weight plus
Gumbel noise.

Texts are split at word boundaries into chunks of CHUNK_WORDS words that carry the next
n - 1 words; a chunk owns the features that start in its own words, so every run of
words is counted once.  Chunks of long texts are dealt over all tasks, so that no text
is one task's work; the others stay where they are read.  Each pass turns a chunk into
its features' buckets.  The first sums buckets over the corpus and the target (map-side;
the driver sees one number a bucket).  The second sums each chunk's gains; sums and
counts of a long text's chunks are then added by document.

A rank is the number of drawn rows of higher scores, by a table of scores (at most
SCORES of them: gains and noise are logarithms of 64-bit numbers), plus the place among
equal scores by id; equal rows are summed before and laid out after, so repeated rows
are no hot group.

Cases: a null or empty text has no features and weight 0; a null id draws its noise as
an empty id and comes after all others among equal scores; repeated rows are drawn each,
with ranks of their own; ties of score and id go to fewer features, then the smaller
weight; a very long text is many chunks; without a target, or documents, counts are 0;
an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, rows_of, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N, BUCKETS = 2, 10_000
SEED, PERCENT, LEAST_WORDS = 7, 25, 20
CHUNK_WORDS = 4096
#: Texts of more bytes than this are dealt out chunk by chunk.
LONG_BYTES = 64 << 10
#: Bound of distinct scores: |gain| < 1000 ln 2**64, noise between -3200 and 22300.
SCORES = 2 * 44_400 + 25_500


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else.  lower() is the quicker way for texts in which it changes no other character."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def chunks(rows: DataFrame, text_col: str, n: int = N, size: int = CHUNK_WORDS) -> DataFrame:
    """rows' other columns, and a row a chunk: words (its own and up to n - 1 more), own (how many it owns), n_chunks.  A text without words is one empty chunk."""
    rest = [c for c in rows.columns if c != text_col]
    worded = rows.select(*rest, F.regexp_extract_all(lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    count = F.greatest(F.ceil(F.size("w") / F.lit(size)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.slice("w", i * size + 1, F.lit(size + n - 1)).alias("words"), F.least(F.lit(size), F.size("w") - i * size).alias("own")))
    return worded.select(*rest, count.alias("n_chunks"), F.inline(cut))


def dealt(rows: DataFrame, text_col: str, n: int = N, size: int = CHUNK_WORDS, long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts that stay where they are read, one chunk each; chunks of long texts, dealt over all tasks)."""
    long = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) > long_bytes
    return chunks(rows.where(~long), text_col, n, max(long_bytes, 1)), chunks(rows.where(long), text_col, n, size).repartition(partitions(rows))


def features(n: int = N, buckets: int = BUCKETS) -> Column:
    """Buckets of the features that a chunk owns: runs of 1 to n words, by CRC-32 of the run's bytes."""
    def run(k: int):
        return lambda x, i: (F.crc32(F.concat_ws(" ", x, *(F.get("words", i + j) for j in range(1, k))).cast("binary")) % buckets).cast("int")

    starts = lambda k: F.greatest(F.least(F.col("own"), F.size("words") - (k - 1)), F.lit(0))
    runs = [F.transform(F.slice("words", F.lit(1), starts(k)), run(k)) for k in range(1, n + 1)]
    return F.concat(*runs)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS, **deal) -> list[int]:
    """How many features of all texts each bucket holds."""
    counts = [0] * buckets
    short, long = (c.select(F.explode(features(n, buckets)).alias("b")).groupBy("b").count() for c in dealt(texts.select(text_col), text_col, n, **deal))
    for r in short.unionAll(long).groupBy("b").agg(F.sum("count").alias("n")).collect():  # a row a bucket
        counts[r["b"]] = r["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """A bucket's gain: 1000 times the logarithm of the smoothed ratio of its shares, floored."""
    s, t, b = float(sum(corpus)), float(sum(target)), len(corpus)
    return [math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus, target)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", n: int = N, **deal) -> DataFrame:
    """A row a document: doc_id, n_words, n_features, n_chunks and weight, the floored mean of its features' gains."""
    of_bucket = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    summed = ("n_words", "n_features", "total")

    def sums(chunk: DataFrame) -> DataFrame:
        found = chunk.select("doc_id", "row", "n_chunks", F.col("own").cast("long").alias("n_words"), features(n, len(gain)).alias("b"))
        total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.get(of_bucket, x))
        return found.select("doc_id", "row", "n_chunks", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))

    short, long = (sums(c) for c in dealt(rows, "text", n, **deal))
    long = long.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.max("n_chunks").alias("n_chunks"), *(F.sum(c).alias(c) for c in summed))
    both = short.unionByName(long)
    floored = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return both.select("doc_id", "n_words", "n_features", "n_chunks", floored.alias("weight"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, times 1000 and floored; of equal ids the same."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(of.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed, stored, with score and rank: 1, 2, 3... of the percent of documents of least_words words with the highest scores, else null."""
    spark = weighed.sparkSession
    rows = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    scores = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()  # at most SCORES rows
    drawn, above, levels = sum(r["n"] for r in scores) * percent // 100, 0, []
    for r in sorted(scores, key=lambda r: -r["score"]):
        if above < drawn:
            levels.append((r["score"], above))
            above += r["n"]
    lowest = levels[-1][0] if levels else None
    taken = able & (F.col("score") >= F.lit(lowest).cast("long")) if levels else F.lit(False)
    columns = rows.columns
    rest = rows.where(~taken).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not levels:
        return rest
    equal = rows.where(taken).groupBy(*columns).agg(F.count("*").alias("equal"))
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words", "n_chunks")
    before = F.sum("equal").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("equal")
    start = rows_of(spark, levels, "score bigint, above bigint")
    ranked = equal.withColumn("before", before).join(F.broadcast(start), "score").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "equal")))
    rank = F.col("above") + F.col("before") + F.col("again")
    return rest.unionByName(ranked.select(*columns, F.when(rank <= drawn, rank).alias("rank")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(weigh(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


#: DuckDB has no CRC-32: a bit by bit table, then a fold over the bytes of each distinct feature.
ORACLE = rf"""
WITH z AS (SELECT list(c ORDER BY i) AS z FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT {_WORDS} AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
y AS (SELECT unnest(w) AS f FROM e UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM e)),
v AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM x UNION SELECT f FROM y)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, k: xor(c >> 8, z[(xor(c, k) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {BUCKETS} AS b FROM v, z),
s AS (SELECT b, count(*) AS s FROM x JOIN b USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN b USING (f) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS cs, (SELECT count(*) FROM y)::DOUBLE AS ct),
g AS (SELECT b.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (cs + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (ct + {BUCKETS}))))::BIGINT AS g FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
q AS (SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN b USING (f) JOIN g USING (b) GROUP BY r),
a AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN q USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM a WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM a LEFT JOIN k USING (r)
"""
