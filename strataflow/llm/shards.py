"""Token ids in training order, in binary shards.

Texts become sequences of at most `length` ids, each text ending with the end id. A keyed Feistel network permutes the
sequences' numbers; it works on the least power of four that holds them all, and results outside are sent through again
(cycle walking) until they fall inside, so every sequence has one slot and every slot one sequence. Slots are dealt out
by range, and each range of slots is a shard: records of equal size, so slot s is at one computable place, and a
reader can go on from any slot.

A record is the number of ids (32 bits, little-endian) and `length` ids of 16 bits (32 if the vocabulary needs it),
padded with zeros. A shard is written under another name and then moved to its own, so a lost or repeated task leaves
no half shard.

The sequences' numbers follow the order in which Spark reads the input's files, which is the same each time the same
files are read with the same settings; rows that come from a shuffle are written first. Tokenisation runs twice, once to
count, so that no ids have to be kept. A partition that doesn't give the number of sequences counted before fails.

Cases: null and empty text are one sequence that holds the end id alone. Repeated rows are sequences each. Strings of
special tokens inside a text are encoded as ordinary text. An empty table makes no shard. Other columns are not carried.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.arrowtext import mix, release, slices
from strataflow.session import read_table, shared_path, ship_package, steady


#: Bytes of shards that a task writes, at most, but for a shard's own size.
PART = 512_000_000


@dataclass(frozen=True)
class Layout:
    """length: ids in a sequence; shard: records in a shard; key: of the permutation; end: the id that ends a text."""

    vocabulary: str
    length: int = 256
    shard: int = 16_384
    key: int = 20_240_607
    end: int = 50_256
    width: int = 2

    @property
    def stride(self) -> int:
        return 4 + self.length * self.width


def default_layout() -> Layout:
    import public_tokenizers

    return Layout(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(text: str | None, layout: Layout) -> bytes:
    """The text's ids and the end id, little-endian in layout.width bytes each."""
    ids = _encoding(layout.vocabulary).encode_ordinary(text or "")
    ids.append(layout.end)
    out = array({2: "H", 4: "I"}[layout.width], ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def token_ids(text: str | None, layout: Layout) -> np.ndarray:
    return np.frombuffer(token_bytes(text, layout), f"<u{layout.width}")


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 sends each number."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(rounds):
            left, right = right, left ^ (mix(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def unfeistel(slots: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The numbers that feistel sends to these slots."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in reversed(range(rounds)):
            left, right = right ^ (mix(left + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) & low), left
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def count_sequences(docs: DataFrame, layout: Layout) -> dict[int, int]:
    """Number of sequences of each input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = _encoding(layout.vocabulary).encode_ordinary, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += len(encode(text or "")) // layout.length + 1
        release()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "n long").select(F.spark_partition_id().alias("part"), "n").where("n > 0")
    return {r["part"]: r["n"] for r in rows.collect()}  # a row for each partition


def sequences(docs: DataFrame, layout: Layout, counts: dict[int, int]) -> DataFrame:
    """doc_id, seq, slot, ids of every sequence; counts: as from count_sequences."""
    parts = sorted(counts)
    total = sum(counts.values())
    base = {p: (b, counts[p]) for p, b in zip(parts, np.cumsum([0] + [counts[p] for p in parts[:-1]]).tolist(), strict=True)} if parts else {}
    bases = docs.sparkSession.sparkContext.broadcast(base)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = end = None
        step = layout.length * layout.width
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column("text"), 64_000_000)):
            bodies = [token_bytes(text, layout) for text in batch.column("text").to_pylist()]
            if bodies and at is None:
                at, n_here = bases.value[TaskContext.get().partitionId()]
                end = at + n_here
            sizes = np.array([len(x) for x in bodies], np.int64)
            n = -(-sizes // step)
            row = np.repeat(np.arange(len(bodies)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(np.cumsum(sizes) - sizes, n) + seq * step
            offs = np.append(starts, sizes.sum()).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offs), pa.py_buffer(b"".join(bodies))])
            if len(row) and at + len(row) > end:
                raise RuntimeError("the input's partitions are not those that were counted")
            slot = feistel(np.arange(at, at + len(row)) if len(row) else row, total, layout.key)
            at = at + len(row) if len(row) else at
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(seq, pa.int32()), pa.array(slot), ids], names=["doc_id", "seq", "slot", "ids"])
        if at != end:
            raise RuntimeError("the input's partitions are not those that were counted")
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seq int, slot long, ids binary")


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_shards(placed: DataFrame, folder: str, layout: Layout) -> DataFrame:
    """Writes the shards when its rows are asked for: doc_id, seq, slot, shard, at (byte in the shard), n_tokens, checksum (XXH64 of the ids' bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, name = -1, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{name}.{attempt}", name)

        for batch in batches:
            slots, ids = batch.column("slot").to_numpy(), batch.column("ids").to_pylist()
            of = slots // layout.shard
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and of[a] != shard:
                    close()
                    shard = int(of[a])
                    name = f"{root}/shard-{shard:09d}.bin"
                    out = store.open_output_stream(f"{name}.{attempt}")
                if a < b:
                    out.write(b"".join([(len(x) // layout.width).to_bytes(4, "little") + x + bytes(layout.stride - 4 - len(x)) for x in ids[a:b]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("seq"),
                    batch.column("slot"),
                    pa.array(slots // layout.shard),
                    pa.array(slots % layout.shard * layout.stride),
                    pa.array([len(x) // layout.width for x in ids], pa.int64()),
                    pa.array(np.array([xxhash.xxh64_intdigest(x) for x in ids], np.uint64).view(np.int64)),
                ],
                names=["doc_id", "seq", "slot", "shard", "at", "n_tokens", "checksum"],
            )
        close()

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, seq int, slot long, shard long, at long, n_tokens long, checksum long")


def materialise_order(docs: DataFrame, folder: str, layout: Layout) -> DataFrame:
    """The manifest of all sequences; asking for its rows writes their shards to the folder."""
    ship_package(docs.sparkSession)
    docs = steady(docs.select("doc_id", "text"), "shards-input")
    counts = count_sequences(docs, layout)
    total = sum(counts.values())
    shards = max(1, -(-total // layout.shard))
    parts = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * layout.stride // PART)))
    part = (F.floor(F.col("slot") / layout.shard) * parts / shards).cast("int")
    placed = sequences(docs, layout, counts).repartitionById(parts, part).sortWithinPartitions("slot")
    return write_shards(placed, folder, layout)


def read_slots(folder: str, layout: Layout, start: int, stop: int) -> list[np.ndarray]:
    """The ids in slots start..stop-1, read in order from wherever they begin."""
    store, root = _opened(folder)
    out = []
    while start < stop:
        shard, first = divmod(start, layout.shard)
        n = min(stop - start, layout.shard - first)
        with store.open_input_file(f"{root}/shard-{shard:09d}.bin") as f:
            f.seek(first * layout.stride)
            raw = f.read(n * layout.stride)
        for i in range(n):
            record = raw[i * layout.stride : (i + 1) * layout.stride]
            out.append(np.frombuffer(record, f"<u{layout.width}", int.from_bytes(record[:4], "little"), 4))
        start += n
    return out


def op1_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, slot, shard, at, n_tokens, checksum of every sequence, whose shards are written in the shared folder."""
    return materialise_order(read_table(spark, sf_dir, "documents"), shared_path(spark, "training-shards"), default_layout())
