"""Operator 9, sharding: a hypergeometric communication matrix (native Spark).

Each row gets a draw: a hash of a seed, of all its columns and of its place in the
input, so that even equal rows draw apart; the rows are stored with it, and all
later steps follow from it.  The draw deals rows into source blocks.  From the
blocks' counts and the shards' exact sizes (at most one apart) the driver draws how
many rows each block sends to each shard: one multivariate hypergeometric draw
after another from the places that are left, so the matrix has the law of a uniform
shuffle.  Then each block is permuted locally and cut by its row of the matrix, the
whole rows are exchanged, and each shard is permuted again, in cells by a second
hash so that no task holds a shard: a cell's offset within its shard plus the rank
within the cell is the slot.  Blocks and cells hold BLOCK_ROWS rows or BLOCK_BYTES.

Law: `rows` (counts at most one apart).

Cases: a null text has no bytes; equal texts, repeated rows and null ids are rows
like others; a very long text is a row of its own size; ties of draws (equal 64-bit
hashes) are ordered by the second hash; an empty table gives an empty result; with
fewer rows than shards some are empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, rows_of, stored, table

SHARDS = 24
BLOCK_ROWS = 250_000
BLOCK_BYTES = 64 << 20
MAX_BLOCKS = 16_384
#: Beyond it numpy draws no hypergeometric numbers.
NUMPY_ROWS = 1_000_000_000


def shard_sizes(rows: int, shards: int, seed: int) -> np.ndarray:
    """Exact sizes at most one apart; which shards get one more is drawn too."""
    out = np.full(shards, rows // shards, np.int64)
    out[np.random.default_rng([seed, 1]).permutation(shards)[: rows % shards]] += 1
    return out


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent from each block (their counts given) to each shard (sizes given)."""
    rng = np.random.default_rng([seed, 2])
    left = sizes.copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        # One binary split after another, shard by shard.
        rest, need = int(left.sum()), int(n)
        for j in range(len(sizes)):
            others = rest - int(left[j])
            out[i, j] = _hypergeometric(rng, int(left[j]), others, need)
            need -= int(out[i, j])
            rest = others
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, draws))
    return _by_rejection(rng, good, bad, draws)


def _log_factorial(x: int) -> np.longdouble:
    """ln x!, by Stirling's series in extended precision: its error stays below 10**-6 up to 10**13."""
    if x < 64:
        return np.longdouble(math.lgamma(x + 1))
    n = np.longdouble(x)
    return n * np.log(n) - n + np.log(2 * np.longdouble(np.pi) * n) / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def _by_rejection(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric number of any size, by the ratio of uniforms (Stadlober 1989): a table mountain hat around the mode."""
    total = good + bad
    few, many, m = min(good, bad), max(good, bad), min(draws, total - draws)
    share = few / total
    centre = m * share + 0.5
    spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mass = lambda k: -(_log_factorial(k) + _log_factorial(few - k) + _log_factorial(m - k) + _log_factorial(many - m + k))
    mode = (m + 1) * (few + 1) // (total + 2)
    highest, last = mass(mode), min(m, few)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u) if u else -1
        if 0 <= k <= last and k >= m - many and 2 * math.log(u) <= mass(k) - highest:
            break
    k = m - k if good > bad else k
    return k if m == draws else good - k


def _mixed(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _share(draw: Column, parts: int) -> Column:
    """Which of equal ranges of the draws one falls into."""
    return F.floor(F.pmod(draw, F.lit(1 << 30)) * F.lit(parts) / F.lit(1 << 30)).cast("int")


def shard(rows: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """rows' columns, then shard, and slot, which runs from 0 without gaps in each shard.  Columns of rows that have these two names are left out."""
    spark = rows.sparkSession
    # A row is one struct from here on, so that none of its names meets one of this plan's.
    packed = rows.select(F.struct(*(rows[f"`{c.replace('`', '``')}`"] for c in rows.columns if c.lower() not in ("shard", "slot"))).alias("row"))
    drawn = stored(packed.select("row", F.xxhash64(F.lit(seed), "row", F.monotonically_increasing_id()).alias("draw")), "draws")
    n, p = drawn.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = partitions(rows, BLOCK_BYTES)
    blocks = int(min(max(-(-n // BLOCK_ROWS), 4 * p, large), MAX_BLOCKS))
    cells = int(min(max(-(-n // (shards * BLOCK_ROWS)), -(-4 * p // shards), -(-large // shards)), MAX_BLOCKS))
    dealt = drawn.withColumn("block", _share(F.shiftright("draw", 32), blocks))
    counts = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}  # at most MAX_BLOCKS rows
    present = sorted(counts)
    matrix = communication_matrix([counts[b] for b in present], shard_sizes(n, shards, seed), seed)
    bounds = [(b, [int(x) for x in np.cumsum(m)]) for b, m in zip(present, matrix)]
    cuts = rows_of(spark, bounds or [(0, [0])], "block int, until array<bigint>")  # blocks * shards numbers
    local = Window.partitionBy("block").orderBy("draw", _mixed(seed + 1, "draw"))

    def sent(df: DataFrame) -> DataFrame:
        """The permuted blocks, cut; a cell is a range of the second hash, so that cells in order make one permutation of the shard."""
        ranked = df.withColumn("rank", F.row_number().over(local).cast("long")).join(F.broadcast(cuts), "block")
        placed = ranked.withColumn("shard", F.size(F.filter("until", lambda x: x < F.col("rank"))).cast("int")).drop("block", "rank", "until")
        return placed.withColumn("again", _mixed(seed + 2, "draw")).withColumn("cell", _share(F.col("again"), cells))

    # The cells' sizes follow from the draws alone; the rows themselves move twice and no more.
    sizes = keep(sent(dealt.select("draw", "block")).groupBy("shard", "cell").agg(F.count("*").alias("size")))  # shards * cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "cell").orderBy(F.pmod("again", F.lit(1 << 30)), "again", "draw")
    placed = sent(dealt).withColumn("place", F.row_number().over(again) - 1).join(F.broadcast(offsets), ["shard", "cell"])
    return placed.select("row.*", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
