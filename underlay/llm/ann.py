"""Operator 5, approximate nearest neighbours: randomly rotated one-bit codes.

A vector is normalised, turned by a fixed random rotation, and kept as one bit a
dimension (the sign) with one correction scalar, <code, vector>.  For a query q
the inner product with a vector o is estimated as <code, q> / <code, o>.  The query
is quantised to PLANES bits a dimension, so <code, q> is a sum of popcounts of the
packed code with the query's bit planes; codes are never unpacked.  With high
probability the error of the estimate stays below

    (EPSILON * sqrt(1 - <code, o>**2) / sqrt(d - 1) + R) / <code, o>

R, the sum of what quantising took from the query's dimensions over sqrt(d), is no
estimate but a bound.

A block of vectors is searched with a block of queries: the vectors of largest
estimates are measured first, which gives a k-th best exact cosine; then every
vector whose estimate plus error bound reaches it is measured in double precision.

Vectors are dealt into blocks by hash and queries into blocks too; a task holds
one pair of blocks, both of bounded size, and sends k rows a query on.  The few
rows of each query are then ranked.  Every vector is in the index; nothing is
fitted, the rotation comes from a fixed seed.

Cases: null, empty and zero vectors and those with null or non-finite components
take no part; vectors are compared within one number of dimensions; ties go to the
smaller id; copies of a vector are all candidates; rows with a null id take no
part; of rows with one id each is a candidate, except for a query of that id; very
long vectors are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

K_NEAREST = 5
EPSILON = 3.0
BLOCK_QUERIES = 8_192
BLOCK_VECTORS = 32_768
SEED = 7
FIRST = 64
PLANES = 6


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits and correction scalars."""
    turned = units @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as (words, rows) of 64 bits."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(wide.view(np.uint64).T)


def products(codes: np.ndarray, ones: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, float]:
    """<code, query> of each packed code, from popcounts alone, and how far quantising may have moved any of them."""
    d, low = len(query), query.min()
    step = (query.max() - low) / ((1 << PLANES) - 1) or 1.0
    levels = np.rint((query - low) / step).astype(np.uint8)
    total = np.zeros(codes.shape[1], np.int64)
    for b in range(PLANES):
        plane = packed(np.packbits(levels >> b & 1)[None])
        total += np.bitwise_count(codes & plane).sum(axis=0, dtype=np.int64) << b
    chosen = low * ones + step * total
    return (2 * chosen - (low * d + step * int(levels.sum()))) / np.sqrt(d), float(np.abs(query - (low + step * levels)).sum() / np.sqrt(d))


def search(ids: np.ndarray, units: np.ndarray, bits: np.ndarray, scalar: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of the k nearest in one block for each query."""
    d, codes = units.shape[1], packed(bits)
    ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
    spread = epsilon * np.sqrt(np.maximum(1 - scalar**2, 0)) / np.sqrt(max(d - 1, 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, q in zip(query_ids, queries):
        inner, rounding = products(codes, ones, q @ turn)
        e, error = inner / scalar, (spread + rounding) / scalar + 1e-9
        e[ids == own] = -np.inf
        some = np.argpartition(-e, FIRST)[:FIRST] if len(e) > FIRST else np.arange(len(e))
        some = some[np.isfinite(e[some])]
        exact = cosines(units[some], q)
        if len(e) > FIRST:
            least = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
            some = np.flatnonzero((e + error >= least) & np.isfinite(e))
            exact = cosines(units[some], q)
        best = np.lexsort((ids[some], -exact))[:k]
        out.append((np.full(len(best), own), ids[some[best]], exact[best]))
    return tuple(np.concatenate([x[j] for x in out]) if out else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, float)))


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the vectors of a block with their codes; right: a block of queries."""
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        units, queries = _matrix(left["unit"]), _matrix(right["unit"])
        bits = np.frombuffer(b"".join(left["bits"].to_pylist()), np.uint8).reshape(len(units), -1)
        found = search(left["id"].to_numpy(), units, bits, left["scalar"].to_numpy(), right["id"].to_numpy(), queries, rotation(units.shape[1]), k)
        return pa.table([pa.array(x, f.type) for x, f in zip(found, _OUT)], schema=_OUT)

    return run


def _codes(batches):
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            units = unit(_matrix(part.column(2)))
            turn = turns.setdefault(int(d), rotation(int(d)))
            bits, scalar = encode(units, turn)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(units), pa.list_(pa.float64())), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(scalar)], names=["id", "d", "unit", "bits", "scalar"])


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K_NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of each query; both tables hold id_col and vector_col."""
    v = F.col(vector_col)
    bad = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bad)) & F.exists(v, lambda x: x != 0)

    def coded(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
        return rows.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("d"), v.cast("array<double>").alias("v")).mapInArrow(_codes, "id long, d int, unit array<double>, bits binary, scalar double")

    n, q = vectors.count(), queries.count()
    vector_blocks = max(1, -(-n // BLOCK_VECTORS), min(n // 2_000, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    query_blocks = max(1, -(-q // BLOCK_QUERIES))
    p = max(partitions(vectors), vector_blocks * query_blocks)

    def block(blocks: int, seed: int) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")

    def all_blocks(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    stored = coded(vectors).withColumn("vb", block(vector_blocks, 1)).withColumn("qb", all_blocks(query_blocks))
    asked = coded(queries).select("id", "d", "unit").withColumn("qb", block(query_blocks, 2)).withColumn("vb", all_blocks(vector_blocks))
    key = ["d", "vb", "qb"]
    stored, asked = stored.repartition(p, *key), asked.repartition(p, *key)
    found = stored.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
