"""The corpus pipeline: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  run() writes each
stage's result as Parquet in the shared folder and reads it again, so a stage's
lineage ends with its input.  All stages but the last return the columns of
documents.  SQL cannot express the first stage, so the whole pipeline is tested
against plain Python instead.

Cases, for every stage: a null text counts as empty and stays null where a stage
keeps it; null ids are rows of unknown documents; repeated rows are decided alike; a
very long text is read whole; ties go to the smaller id; an empty table gives an
empty one; of a table with more columns, or with some of the names that operators
use themselves, the columns of documents are read and the others ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underlay.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from underlay.llm.common import fold, forget, keep, new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
HIT_WORDS = decontamination.WINDOW


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go; it learns from the labelled ones outside the held-out fold.

    Without labels of both classes, and for texts without words, the score is the share of toxic labels.  Equal rows
    stay or go together; a null id has no label and is scored like others.
    """
    model = toxicity.train(docs.where(fold(F.col("doc_id"), 5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller id holds go; the documents stay, with the text and length that are left.

    A null id ranks after all others, and rows of one id count as one document.  A null text comes back as an empty
    one, and a document that loses all its lines stays as an empty text.
    """
    kept = line_dedup.dedup(docs, carry=("doc_id", "lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row of the smallest id stays; a null id belongs to no group but through its text.

    Ids come before null ones, then the smaller digest of the text.  A blank text is similar to none: its id stays
    with one row, and a null id with every row.
    """
    forget(spark)
    rows = keep(jaccard_join.rooted(docs))
    forget(spark)
    blank, unnamed = F.col("root").isNull(), F.col("id").isNull()
    first = rows.where(~blank).groupBy("root").agg(F.min(F.struct(unnamed.alias("unnamed"), "id", "digest")).alias("of")).select("of.id", "of.digest", F.lit(False).alias("blank"))
    first = first.unionAll(rows.where(blank).select("id", "digest", F.lit(True)).distinct())
    named = first.where(~unnamed).groupBy("id").agg(F.min(F.struct("blank", "digest")).alias("of")).select("id", "of.digest", F.lit(False).alias("every"))
    stay = named.unionAll(first.where(unnamed).select("id", "digest", F.col("blank").alias("every")))
    place = lambda df, doc_id, digest, *more: df.select(*more, F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id_"), doc_id.isNull().alias("unnamed_"), digest.alias("digest_"))
    key = ["id_", "unnamed_", "digest_"]
    equal = place(rows, F.col("id"), F.col("digest")).groupBy(*key).agg(F.count("*").alias("k"))
    stay = keep(place(stay, F.col("id"), F.col("digest"), "every").join(equal, key).select(*key, (F.col("every") | (F.col("k") == 1)).alias("all_")))
    keyed = place(docs, F.col("doc_id"), jaccard_join.digest(F.col("text")), *COLUMNS)
    # Only rows that equal another are grouped, so that the others' texts are sorted and shuffled once.
    alone = keyed.join(stay.where("all_"), key, "left_semi").select(*COLUMNS)
    copies = keyed.join(stay.where("not all_"), key, "left_semi").dropDuplicates(key).select(*COLUMNS)
    return alone.unionAll(copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with as many words in occurrences of benchmark windows as one window has go, of whatever items they are.

    A hit of a shorter item alone is too few words, so common phrases cost no document.  Without a benchmark, and
    without words, nothing is hit.
    """
    blocks = decontamination.build(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.contamination(docs, blocks, carry=COLUMNS).where(F.col("n_hit") < HIT_WORDS).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: their number, and digests of the ids and of the text decoded from them.

    A row a document, null ids and repeated rows too; an empty text has no tokens and the digests of nothing.
    """
    return bpe.encode(docs, bpe.tokenizer_path(), carry=("doc_id", "lang", "source"), want=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
