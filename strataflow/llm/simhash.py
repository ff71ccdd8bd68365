"""SimHash near-duplicate groups by tiled exact comparison.

Every whole text becomes a fingerprint over its word shingles. The distinct fingerprints are sorted by population
count (in all and by quarter) and cut into tiles; each tile, and each pair of tiles, is one task row, in which numpy xors and counts
bits of all pairs of fingerprints, but for those blocks whose population counts differ by more than the radius, as
no fingerprints of theirs can be within it. A task keeps a spanning forest of the links it finds, never all pairs of
a group, and for a pair of tiles only what joins components that the tiles had; components of these forests are the
components of all links.

With several lanes a fingerprint is longer: the first 64 bits within `lead` differing bits select pairs, and the
whole of it decides.

Cases: null or empty text, or text of white space alone, has fingerprint zero, which links like any other; with fewer
words than a shingle has, the whole sequence is the one shingle. Exact copies and repeated rows share a fingerprint
and a component. A null doc_id keeps its row; a component's id is its least doc_id that isn't null, or null without
any. An empty table gives an empty result.

The comparison is exact, and so grows with the square of the number of distinct fingerprints. `similar` uses the links
only to select, and confirms pairs by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.arrowtext import mix, release
from strataflow.llm.components import connected_components
from strataflow.session import cut, materialise, read_table, ship_package

#: Fingerprints in a tile, about, and in a block of a tile.
TILE, BLOCK = 4_096, 512
#: From this many tiles on, tiles grow, up to WIDE fingerprints; then their number does.
TILES, WIDE = 64, 4_194_304
#: Texts, and shingles, in a chunk of a loose component, about; the bytes that bits of frequent shingles may take.
CHUNK, CHUNK_SHINGLES, FREQUENT_BYTES = 8_192, 1_000_000, 64_000_000


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    return np.stack([h, *(mix(h ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(1, lanes))], axis=1)


def _shingles(text: bytes | None, size: int) -> list[int]:
    """Hashes of a text's shingles, in order."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[min(size, len(words)) - 1 :])]  # noqa: B905


def _shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(np.array(_shingles(text, size), np.uint64))


class _Signer:
    """Fingerprints of texts, one after another; the bits of many texts are counted at once."""

    def __init__(self, words: int, lanes: int, flush: int = 40_000):
        self.words, self.lanes, self.flush = words, lanes, flush
        self.out: list[np.ndarray] = []
        self.hashes: list[int] = []
        self.sizes: list[int] = []
        self.large: np.ndarray | None = None

    def add(self, text: bytes | None) -> None:
        self.put(_shingles(text, self.words))

    def put(self, hashes: list[int]) -> None:
        self.hashes.extend(hashes)
        self.sizes.append(len(hashes))
        if len(self.hashes) >= self.flush:
            self.done()

    def done(self) -> None:
        if not self.sizes:
            return
        sizes = np.array(self.sizes)
        out = np.zeros((len(sizes), self.lanes), np.uint64)
        if self.hashes:
            h = np.array(self.hashes, np.uint64)
            full = np.flatnonzero(sizes)
            ends = np.cumsum(sizes[full])
            counts = np.zeros((len(full), 64 * self.lanes), np.int64)
            for a in range(0, len(h), 65_536):  # a long text is counted piece by piece
                b = min(len(h), a + 65_536)
                bits = np.unpackbits(_lanes(h[a:b], self.lanes).view(np.uint8).reshape(b - a, -1), axis=1, bitorder="little")
                i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right"))
                cuts = np.concatenate(([0], ends[i:j] - a))
                counts[i : j + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            over = counts * 2 > sizes[full][:, None]
            out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(len(full), self.lanes)
        self.out.append(out)
        self.hashes, self.sizes = [], []

    def take(self) -> np.ndarray:
        self.done()
        out = np.concatenate(self.out) if self.out else np.zeros((0, self.lanes), np.uint64)
        self.out = []
        return out


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """doc_id and the lanes f0, f1, ... of each row's fingerprint, as longs of the same bits."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(words, lanes)
        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                signer.add(text.as_py())
            f = signer.take().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(lanes))], names=["doc_id", *names])
        release()

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _quarters(f: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(f >> np.uint64(16 * q) & np.uint64(0xFFFF)) for q in range(4)], axis=1).astype(np.int16)


def _blocks(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a tile's blocks, and the least and largest population counts there, by quarter and in all."""
    q = _quarters(f)
    q = np.concatenate((q, q.sum(axis=1, keepdims=True, dtype=np.int16)), axis=1)
    starts = np.arange(0, len(f), BLOCK)
    return starts, np.minimum.reduceat(q, starts, axis=0), np.maximum.reduceat(q, starts, axis=0)


class _Forest:
    """Components of nodes, with an edge kept for each union. label: of components known already, by a node in each."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.edges: list[np.ndarray] = []

    def kept(self) -> np.ndarray:
        return np.concatenate(self.edges, axis=1) if self.edges else np.zeros((2, 0), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, first = np.unique(high, return_index=True)  # each component joins one lower one
            self.edges.append(np.stack((i[first], j[first])))
            to = np.arange(len(self.label))
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def _compare(a: np.ndarray, b: np.ndarray | None, lead: int, radius: int, label: np.ndarray | None = None) -> _Forest:
    """Forest of the links among a's rows, or between a's and b's (counted after a's). label: components known before."""
    both = a if b is None else np.concatenate((a, b))
    forest, shift = _Forest(np.arange(len(both)) if label is None else label), 0 if b is None else len(a)
    x, y = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray((a if b is None else b)[:, 0])
    if not len(x) or not len(y):
        return forest
    xs, xlow, xhigh = _blocks(x)
    ys, ylow, yhigh = _blocks(y)
    for i, at in enumerate(xs):
        gap = np.maximum(0, np.maximum(ylow - xhigh[i], xlow[i] - yhigh))
        near = np.flatnonzero((gap[:, :4].sum(axis=1) <= lead) & (gap[:, 4] <= lead))
        part = x[at : at + BLOCK, None]
        for j in near if b is not None else near[near >= i]:
            close = np.bitwise_count(part ^ y[None, ys[j] : ys[j] + BLOCK]) <= lead
            if b is None and i == j:
                close &= ~np.tri(*close.shape, dtype=bool)
            p, q = np.nonzero(close)
            if len(p):
                p, q = p + at, q + ys[j] + shift
                if both.shape[1] > 1:
                    ok = np.bitwise_count(both[p] ^ both[q]).sum(axis=1, dtype=np.int64) <= radius
                    p, q = p[ok], q[ok]
                forest.add(p, q)
    return forest


def links(nodes: DataFrame, lanes: int = 1, radius: int = 4, lead: int | None = None) -> DataFrame:
    """Edges (src, dst) whose components are those of all links within the radius.

    nodes: distinct long `node` with the lanes f0, f1, ...
    """
    spark, lead = nodes.sparkSession, radius if lead is None else lead
    names = [f"f{i}" for i in range(lanes)]
    mask = 0xFFFF
    quarter = [F.bit_count(F.shiftrightunsigned("f0", 16 * q).bitwiseAND(F.lit(mask))) for q in range(4)]
    order = [F.bit_count("f0"), *quarter[:3], F.col("f0")]
    n = nodes.count()
    tiles_n = max(1, -(-n // TILE)) if n < TILE * TILES else max(TILES, -(-n // WIDE))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        node = t.column("node").to_numpy()
        f = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        pops = np.bitwise_count(f[:, 0].view(np.uint64))
        forest = _compare(f.view(np.uint64), None, lead, radius)
        yield pa.RecordBatch.from_pydict({"nodes": pa.array([node.tobytes()]), "prints": pa.array([f.tobytes()]), "labels": pa.array([forest.label.astype("<i8").tobytes()]), "inner": pa.array([node[forest.kept()].tobytes()]), "low": pa.array([int(pops.min())], pa.int32()), "high": pa.array([int(pops.max())], pa.int32())})

    packed = nodes.repartitionByRange(tiles_n, *order).sortWithinPartitions(*order).mapInArrow(pack, "nodes binary, prints binary, labels binary, inner binary, low int, high int")
    tiles = materialise(packed.withColumn("tile", F.spark_partition_id()), "simhash-tiles")
    bounds = {r["tile"]: (r["low"], r["high"]) for r in tiles.select("tile", "low", "high").collect()}  # a row for each tile
    at = sorted(bounds)
    pairs = [(a, b) for i, a in enumerate(at) for b in at[i + 1 :] if max(bounds[b][0] - bounds[a][1], bounds[a][0] - bounds[b][1]) <= lead]
    todo = spark.createDataFrame([(t, a, b) for a, b in pairs for t in (a, b)], "tile int, a int, b int")  # by tiles, not rows

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("tile", "nodes", "prints", "labels")), strict=True))
        a, b = (np.frombuffer(p, np.uint64).reshape(-1, lanes) for _, _, p, _ in rows)
        node = np.concatenate([np.frombuffer(x, np.int64) for _, x, _, _ in rows])
        first, second = (np.frombuffer(x, "<i8") for *_, x in rows)
        edges = node[_compare(a, b, lead, radius, np.concatenate((first, second + len(a)))).kept()]
        return pa.table({"src": edges[0], "dst": edges[1]})

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("inner"):
                edges = np.frombuffer(body.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"src": edges[0], "dst": edges[1]})

    across = tiles.select("tile", "nodes", "prints", "labels").join(F.broadcast(todo), "tile").groupBy("a", "b").applyInArrow(compare, "src long, dst long")
    return across.unionByName(tiles.select("inner").mapInArrow(inner, "src long, dst long"))


def near_duplicates(docs: DataFrame, words: int = 4, lanes: int = 1, radius: int = 4, lead: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, the lanes of the fingerprint, component_id."""
    ship_package(docs.sparkSession)
    names = [f"f{i}" for i in range(lanes)]
    printed = materialise(fingerprints(docs, words, lanes), "simhash").withColumn("node", F.col("f0") if lanes == 1 else F.xxhash64(*names))
    nodes = cut(printed.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(n).alias(n) for n in names)))
    roots = connected_components(links(nodes.select("node", *names), lanes, radius, lead))
    return printed.join(_component_ids(nodes, roots), "node").select("doc_id", *names, "component_id")


def _component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id: the least doc_id of the component."""
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # written, so that both sides of the join are plain exchanges, of which Spark splits a large component's part
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    return rooted.join(ids, "root").select("node", "component_id")


def _set_prints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """doc_id, key (of the text), lanes of the fingerprint of the set of shingles, the set's own hash, its size."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(words, lanes)
        for batch in batches:
            own, size = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                s = _shingle_set(text.as_py(), words)
                signer.put(s.tolist())
                own.append(int(mix(s).sum(dtype=np.uint64)))
                size.append(len(s))
            f = signer.take().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(lanes)), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(size, pa.int64())], names=["doc_id", "key", *names, "own", "size"])
        release()

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("key", *names, "own", "size"))])
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


class _Overlaps:
    """How many shingles each set shares with others.

    Shingles of one set alone are left out. Those of many sets are bits of a row for each set, whose common ones are
    counted; the others have a list of their sets each.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        values, code, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sets)), self.size)
        room = FREQUENT_BYTES * 8 // max(1, len(sets))
        often = np.flatnonzero(times >= max(2, len(sets) // 64))
        often = often[np.argsort(-times[often], kind="stable")[:room]]
        place = np.full(len(values), -1)
        place[often] = np.arange(len(often))
        self.bits = np.zeros((len(sets), max(1, -(-len(often) // 64))), np.uint64)
        at = place[code]
        dense = at >= 0
        np.bitwise_or.at(self.bits, (of[dense], at[dense] >> 6), np.uint64(1) << (at[dense] & 63).astype(np.uint64))
        rare = ~dense & (times[code] > 1)
        # the sets of each rare shingle, one shingle after another, and the rare shingles of each set
        order = np.argsort(code[rare], kind="stable")
        self.lists = of[rare][order]
        self.ends = np.cumsum(np.bincount(code[rare], minlength=len(values)))
        self.rare, self.until = code[rare], np.cumsum(np.bincount(of[rare], minlength=len(sets)))

    def __call__(self, u: int, others: np.ndarray) -> np.ndarray:
        both = np.zeros(len(others), np.int64)
        mine = self.bits[u]
        for w in np.flatnonzero(mine):
            both += np.bitwise_count(self.bits[others, w] & mine[w])
        own = self.rare[(self.until[u - 1] if u else 0) : self.until[u]]
        if len(own):
            met = np.concatenate([self.lists[(self.ends[c - 1] if c else 0) : self.ends[c]] for c in own.tolist()])
            both += np.bincount(met, minlength=len(self.size))[others]
        return both


def _confirmed(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least that, by breadth-first search."""
    shared = _Overlaps(sets)
    size = shared.size
    edges: list[tuple[int, int]] = []
    rest, queue = np.flatnonzero(size), []
    while queue or len(rest):
        if queue:
            u = queue.pop()
        else:
            u, rest = int(rest[0]), rest[1:]
        near = rest[np.minimum(size[rest], size[u]) >= similarity * np.maximum(size[rest], size[u]) - 1e-9]
        if not len(near):
            continue
        both = shared(u, near)
        hit = near[both >= similarity * (size[near] + size[u] - both) - 1e-9]
        if not len(hit):
            continue
        edges += [(u, int(v)) for v in hit]
        queue += hit.tolist()
        left = np.ones(len(size), bool)
        left[hit] = False
        rest = rest[left[rest]]
    return edges


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, lanes: int = 4, radius: int = 72, lead: int = 24) -> DataFrame:
    """Per row of docs: doc_id, component_id, of links of at least that Jaccard similarity of the sets of shingles.

    Fingerprints of sets within the radius make loose components. All pairs in one of these are compared by their
    shingles, and only pairs that reach the similarity are links. Members of a large loose component are dealt into
    chunks, and each pair of chunks is a group of its own. Texts without a word are alike.
    """
    ship_package(docs.sparkSession)
    names = [f"f{i}" for i in range(lanes)]
    printed = materialise(_set_prints(docs, words, lanes), "simhash").withColumn("node", F.xxhash64(*names, "own", "size"))
    nodes = cut(printed.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.min("size").alias("size"), *(F.min(n).alias(n) for n in names)))
    loose = connected_components(links(nodes.select("node", *names), lanes, radius, lead))
    rooted = nodes.select("node", "key", "size").join(loose, "node")
    many = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    chunks = materialise(rooted.groupBy("root").agg(many.cast("int").alias("chunks")), "simhash-chunks")
    dealt = cut(rooted.join(chunks, "root").select("node", "key", "root", "chunks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(t.as_py(), words).tobytes() for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "root", "chunks")] + [pa.array(found, pa.binary())], names=["node", "root", "chunks", "set"])
        release()

    # the least of copies is taken before the exchange too, so a frequent text is no large task
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(dealt, "key").select("node", "root", "chunks", "text")
    one = texts.groupBy("node", "root", "chunks").agg(F.min("text").alias("text"))
    made = one.mapInArrow(sets, "node long, root long, chunks int, set binary")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = made.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node", "set")

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        edges = np.array(_confirmed([np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")], similarity), np.int64).reshape(-1, 2)
        return pa.table({"src": node[edges[:, 0]], "dst": node[edges[:, 1]]})

    roots = connected_components(spread.groupBy("root", "a", "b").applyInArrow(check, "src long, dst long"))
    return printed.select("doc_id", "node").join(_component_ids(nodes, roots), "node").select("doc_id", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: four-word shingles, four bits."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
