"""Operator 10, line dedup: levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z);
keys of at least ``min_length`` code points count.  The store holds the 128-bit
hashes of all keys seen so far as runs: tables bucketed by hash and sorted within,
one file a bucket.  Documents come in batches of ascending id.  A batch's distinct
keys, dealt and sorted once, merge-anti-join every run as it lies: a run is neither
exchanged nor sorted again.  What is left is new and becomes a run of level 0, and
``fan`` runs of one level are compacted into one of the next, again by merging them
bucket by bucket.  A line goes if its key was in a run, or if a smaller id of its
own batch holds it.  The lines of the smallest document that holds a key all stay,
its own repeats included.

A store can be kept in a folder and opened again, so that later documents, with
larger ids, are held against all earlier ones.

Cases: a null or empty text is one empty line; a null id ranks after all ids and
rows of one id are one document; equal texts lose all long lines but in the
smallest id; a very long text is read whole by its task, and a line that very many
documents hold is counted before it is dealt; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, forget, keep, new_path, partitions, remove, table

BLANK = b"\t\n\x0b\x0c\r "
LAST = (1 << 63) - 1
BATCHES = 4
BATCH_BYTES = 1 << 40
KEY = ("h1", "h2")


def key_hash(line: bytes, min_length: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short."""
    key = line.strip(BLANK)
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _keys(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in _texts(batch, 1):
                own = {key_hash(x, min_length) for x in text.split(b"\n")} - {None}
                found += own
                counts.append(len(own))
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "h1", "h2"])

    return run


class LineRuns:
    """The levelled store.  add() takes a batch of (id, h1, h2) and says which of its rows are repeats.

    root: the folder of the runs and of their list; given again, it opens the store that close(keep_runs=True) left there.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan: int = 2, root: str | None = None):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.root = root or new_path(spark, "line_runs")
        self.levels: list[list[str]] = []
        listed = spark.read.schema("level int, name string, buckets int").json(f"{self.root}/list") if exists(spark, f"{self.root}/list") else None
        for r in listed.orderBy("level", "name").collect() if listed is not None else ():
            self.buckets = r["buckets"]
            self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
            self.levels[r["level"]].append(r["name"])
            place = f"{self.root}/{r['name']}".replace("'", "\\'")
            spark.sql(f"create table if not exists {r['name']} (h1 bigint, h2 bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{place}'")

    @contextmanager
    def _as_they_lie(self):
        """Plans within deal keys as the runs are dealt, and take the files' order as given."""
        wanted = {
            "spark.sql.shuffle.partitions": str(self.buckets),
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
            "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
            # Else a task could write parts of several buckets, and a bucket have several files.
            "spark.sql.adaptive.localShuffleReader.enabled": "false",
            # Else the anti-joins would go below the aggregate, to all of the batch's rows.
            "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin",
        }
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).select(*KEY)

    def _write(self, keys: DataFrame) -> str:
        """keys: dealt by hash into as many partitions as there are buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        remove(self.spark, f"{self.root}/{name}")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run holds, each with its smallest id."""
        own = batch.groupBy(*KEY).agg(F.min("id").alias("owner"))
        for run in self._runs():
            own = own.join(run.hint("merge"), list(KEY), "left_anti")
        return own

    def add(self, batch: DataFrame) -> DataFrame:
        with self._as_they_lie():
            name = self._write(self.fresh(batch))
        # Read as plain files: where both sides are shuffled, a hot key's rows are split by the adaptive skew join.
        own = self.spark.read.schema("h1 long, h2 long, owner long").parquet(f"{self.root}/{name}")
        lines = batch.join(own, list(KEY), "left")
        repeats = keep(lines.where(F.col("owner").isNull() | (F.col("owner") < F.col("id"))).select("id", *KEY))
        with self._as_they_lie():
            self._push(name, 0)
        return repeats

    def compacted(self, runs: list[str]) -> DataFrame:
        """Runs hold no key in common, so an outer merge of their buckets is their union in order."""
        out = self._run(runs[0])
        for name in runs[1:]:
            out = out.join(self._run(name).hint("merge"), list(KEY), "full_outer")
        return out

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self.compacted(runs))
            for other in runs:
                self._drop(other)
            self._push(merged, level + 1)

    def close(self, keep_runs: bool = False) -> None:
        """Ends the work with the store; its list is written beside its runs, or all of it goes."""
        names = [(i, name) for i, level in enumerate(self.levels) for name in level]
        if keep_runs:
            rows = ", ".join(f"({i}, '{name}', {self.buckets})" for i, name in names)
            if rows:
                self.spark.sql(f"select * from values {rows} as t(level, name, buckets)").coalesce(1).write.mode("overwrite").json(f"{self.root}/list")
        for _, name in names:
            if keep_runs:
                self.spark.sql(f"drop table {name}")  # external: the files stay
            else:
                self._drop(name)
        if not keep_runs:
            remove(self.spark, self.root)
        self.levels = []


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 10, batches: int | None = None, store: str | None = None) -> DataFrame:
    """(id, h1, h2): the keys whose lines a document loses.

    batches: how many; by default one for each BATCH_BYTES, BATCHES at least.
    store: a folder whose runs come first, and which keeps them and the new ones.
    """
    spark = docs.sparkSession
    batches = batches or max(BATCHES, partitions(docs, BATCH_BYTES, 1))
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id")
    cuts = docs.select(rank).agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("id") > F.lit(c)).cast("int")
    path = new_path(spark, "lines")
    docs.select(rank, F.col(text_col)).mapInArrow(_keys(min_length), "id long, h1 long, h2 long").withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, partitions(docs), root=store)
    out = None
    for i in range(len(cuts) + 1):
        gone = runs.add(lines.where(F.col("batch") == i).select("id", "h1", "h2"))
        out = gone if out is None else out.unionAll(gone)
    runs.close(keep_runs=store is not None)
    remove(spark, path)
    forget(spark)
    return out


def _kept(carried: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, gone in zip(_texts(batch, carried), batch.column(carried + 1).to_pylist()):
                parts = text.split(b"\n")
                lines.append(len(parts))
                if gone:
                    gone = set(gone)
                    parts = [x for x in parts if key_hash(x, min_length) not in gone]
                    text = b"\n".join(parts)
                dropped.append(lines[-1] - len(parts))
                kept.append(text)
            out = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *out], names=[*batch.schema.names[:carried], "n_lines", "n_dropped", "kept_text"])

    return run



def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.stack([batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)], axis=1)
        raw = pairs.astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], names=["rank_", "h_"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), min_length: int = 10, batches: int | None = None, store: str | None = None) -> DataFrame:
    """carry columns of docs, n_lines, n_dropped and kept_text of every document; store: see repeats()."""
    gone = repeats(docs, id_col, text_col, min_length, batches, store).mapInArrow(_gather, "rank_ long, h_ binary").groupBy("rank_").agg(F.collect_list("h_").alias("gone_"))
    ranked = docs.select(*carry, F.col(text_col).alias("text_"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rank_"))
    joined = ranked.join(gone.hint("shuffle_hash"), "rank_", "left").select(*carry, "text_", "gone_")
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", n_lines long, n_dropped long, kept_text string"
    return joined.mapInArrow(_kept(len(carry), min_length), ddl)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
