"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length, turned by a random rotation into a space of BITS dimensions at least, and kept as the
signs of their coordinates (packed bits) with one correction scalar, the inner product of the turned vector with its
code. A query's coordinates are rounded to PLANES bits; counts of the bits that its planes share with a code give their
inner product, and with the scalar an estimate of the cosine, within an error bound that holds but for a chance that
falls off as the Gaussian tail at `sigmas`. The exact cosines of the FIRST vectors by estimate give each query a
threshold, and all vectors whose upper bound reaches it are reranked by exact cosines of the original vectors. So the
answer is exact but for bounds that fail.

Queries and codes are dealt into blocks of bounded size, and each pair of a query block and a code block is one group.
Codes alone, without the vectors, go there, once to find the threshold and once to find what reaches it; only the
original vectors of what is reranked are joined.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or otherwise;
nor do rows with null ids. Only vectors of equal length are compared. Rows that repeat an id are candidates each, but
never for a query of that id; a repeated query is asked once, with the least of its vectors. Ties go to the smaller
id. Fewer than k candidates are all returned. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strataflow.session import materialise, read_table, ship_package

K, FIRST, SIGMAS, SEED = 5, 20, 3.0, 11
#: Dimensions of the turned vectors, at least; bits of a query's coordinate.
BITS, PLANES = 512, 6
#: Rows in a block of codes and of queries, about.
VECTORS, QUERIES = 16_384, 8_192


def wide(n: int) -> int:
    """Bits of the code of a vector of n dimensions."""
    return max(BITS, -(-n // 64) * 64)


@lru_cache(4)
def rotation(n: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of n dimensions into wide(n): orthogonal columns out of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, n]).normal(size=(wide(n), n)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the turned unit vectors, and each one's inner product with its code."""
    turned = unit(v) @ rotation(v.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def _words(packed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(packed).view(np.uint64)


def estimates(queries: np.ndarray, bits: np.ndarray, scale: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows) and coded vectors (columns), and their error bounds."""
    turned = unit(queries) @ rotation(queries.shape[1]).T
    d = turned.shape[1]
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.maximum(high - low, 1e-300) / (2**PLANES - 1)
    level = np.rint((turned - low) / step).astype(np.uint8)
    off = np.sqrt(((low + level * step - turned) ** 2).sum(axis=1, keepdims=True) / d)
    codes = _words(bits)
    shared = np.zeros((len(queries), len(codes)), np.int32)
    for j in range(PLANES):
        plane = _words(np.packbits(level >> j & 1, axis=1))
        for w in range(codes.shape[1]):
            shared += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # the sum of the rounded coordinates under the code's signs: twice that over its ones, less that over all
    total = low * d + step * level.sum(axis=1, keepdims=True, dtype=np.int64)
    estimate = (2 * (low * ones + step * shared) - total) / np.sqrt(d) / scale
    return estimate, sigmas * (np.sqrt(np.maximum(0, 1 - scale * scale) / max(d - 1, 1)) + off) / scale + 1e-9


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each row with each row, in double precision; sums go in order, so that equal vectors have equal cosines."""
    dot, x, y = (np.zeros(len(vectors)) for _ in range(3))
    for j in range(vectors.shape[1]):
        q, v = queries[:, j], vectors[:, j]
        dot, x, y = dot + q * v, x + q * q, y + v * v
    return np.clip(dot / np.sqrt(x * y), -1.0, 1.0)


def clean(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), n of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(usable).withColumn("n", F.size("v"))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return np.array(flat).reshape(-1, n)


def _scaled(v: np.ndarray) -> np.ndarray:
    """By a power of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _estimated(queries: pa.Table, codes: pa.Table, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time: their numbers, estimates and bounds; -inf for rows of the query's own id."""
    ids, qids = codes.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    q = _scaled(_matrix(queries.column("v"), n))
    bits = np.frombuffer(b"".join(codes.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
    scale = codes.column("scale").to_numpy()
    for a in range(0, len(q), 64):
        at = np.arange(a, min(len(q), a + 64))
        estimate, off = estimates(q[at], bits, scale)
        estimate[qids[at, None] == ids[None, :]] = -np.inf
        yield at, estimate, off


def _likeliest(key: tuple[pa.Scalar, ...], queries: pa.Table, codes: pa.Table) -> pa.Table:
    """query_id, row, estimate of each query's FIRST by estimate."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and codes.num_rows:
        rows, qids = codes.column("row").to_numpy(), queries.column("vec_id").to_numpy()
        for at, estimate, _ in _estimated(queries, codes, key[0].as_py()):
            first = np.argpartition(-estimate, FIRST, axis=1)[:, :FIRST] if len(rows) > FIRST else np.arange(len(rows))[None].repeat(len(at), 0)
            value = np.take_along_axis(estimate, first, 1)
            ok = value > -np.inf
            out.append((qids[at][:, None].repeat(first.shape[1], 1)[ok], rows[first[ok]], value[ok]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("query_id", "row", "estimate"), columns, strict=True)))


def _reaching(key: tuple[pa.Scalar, ...], queries: pa.Table, codes: pa.Table) -> pa.Table:
    """query_id, row of what may reach its query's threshold, but for what set it."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if queries.num_rows and codes.num_rows:
        rows, qids, least = codes.column("row").to_numpy(), queries.column("vec_id").to_numpy(), queries.column("least").to_numpy()
        for at, estimate, off in _estimated(queries, codes, key[0].as_py()):
            i, j = np.nonzero(estimate + off >= least[at, None])
            out.append((qids[at][i], rows[j]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(2)]
    return pa.table(dict(zip(("query_id", "row"), columns, strict=True)))


def index(vectors: DataFrame) -> DataFrame:
    """row, vec_id, n, v, bits, scale of every vector that takes part: the index, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes = t.column("n").to_numpy()
            bits, scale = [b""] * len(sizes), np.zeros(len(sizes))
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                code, s = encode(_scaled(_matrix(t.column("v").take(pa.array(at)), n)))
                scale[at] = s
                for i, c in zip(at.tolist(), code, strict=True):
                    bits[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("n"), batch.column("v"), pa.array(bits, pa.binary()), pa.array(scale)], names=["vec_id", "n", "v", "bits", "scale"])

    coded = vectors.select("vec_id", "n", "v").mapInArrow(run, "vec_id long, n int, v array<double>, bits binary, scale double")
    return materialise(coded.withColumn("row", F.monotonically_increasing_id()), "ann-index")


def _exact(pairs: DataFrame, asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """query_id, row, vec_id, score of pairs of query_id, n and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes, score = t.column("n").to_numpy(), np.zeros(batch.num_rows)
            for n in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == n))
                score[at.to_numpy()] = cosines(*(_scaled(_matrix(t.column(c).take(at), n)) for c in ("q", "v")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "n", "row", "vec_id")), pa.array(score)], names=["query_id", "n", "row", "vec_id", "score"])

    held = pairs.join(indexed.select("row", "vec_id", "v"), "row").join(asked.select(F.col("vec_id").alias("query_id"), "n", F.col("v").alias("q")), ["query_id", "n"])
    return held.select("query_id", "n", "row", "vec_id", "q", "v").mapInArrow(run, "query_id long, n int, row long, vec_id long, score double")


def _nth(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query_id", "n").orderBy(*order))


def search(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest to each query. queries: vec_id, v, n, as from `clean`."""
    return ranked(*reranked(indexed, queries))


def reranked(indexed: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, n, row, vec_id, score of what sets the thresholds, and of all else that may reach them."""
    asked = queries.groupBy("vec_id", "n").agg(F.min("v").alias("v"))
    n_queries, n_vectors = asked.count(), indexed.count()
    qb, vb = max(1, -(-n_queries // QUERIES)), max(1, -(-n_vectors // VECTORS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(qb)).cast("int"))
    # the place in the index counts, lest rows that repeat an id gather in a block
    codes = indexed.select("row", "vec_id", "n", "bits", "scale").withColumn("vb", F.pmod(F.xxhash64("row"), F.lit(vb)).cast("int")).withColumn("qb", each(qb)).groupBy("n", "qb", "vb")
    spread = lambda q: q.withColumn("vb", each(vb)).groupBy("n", "qb", "vb").cogroup(codes)
    likely = spread(blocked).applyInArrow(_likeliest, "query_id long, row long, estimate double")
    likely = likely.join(indexed.select("row", "n"), "row").withColumn("_nth", _nth([F.desc("estimate"), F.col("row")])).where(F.col("_nth") <= FIRST)
    first = materialise(_exact(likely.select("query_id", "n", "row"), asked, indexed), "ann-first")
    kth = first.withColumn("_nth", _nth([F.desc("score"), F.col("row")])).where(F.col("_nth") == K).select(F.col("query_id").alias("vec_id"), "n", F.col("score").alias("least"))
    # with fewer than K to compare with, everything there is was among the first
    known = blocked.join(kth, ["vec_id", "n"])
    pairs = spread(known).applyInArrow(_reaching, "query_id long, row long").join(indexed.select("row", "n"), "row")
    more = pairs.join(first.select("query_id", "row"), ["query_id", "row"], "left_anti")
    return first, _exact(more.select("query_id", "n", "row"), asked, indexed)


def ranked(first: DataFrame, more: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of the K nearest."""
    found = first.unionByName(more).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")))
    return found.where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest to each vector whose id is divisible by 50."""
    ship_package(spark)
    rows = clean(read_table(spark, sf_dir, "embeddings"))
    return search(index(rows), rows.where("vec_id % 50 = 0"))


#: DuckDB SQL for op8_one_bit_codes, of all cosines: for small tables, with squares of components that are doubles.
ORACLE_SQL = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 q AS (SELECT vec_id AS query_id, n, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id, n),
 s AS (SELECT query_id, vec_id, list_cosine_similarity(q.v, e.v) AS score FROM q JOIN e ON q.n = e.n AND query_id <> vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
