"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split into words as the tokenizer's own splitter does. Blocks of documents list their distinct words; that
table, dealt out by word, lets the tokenizer see each distinct word once, however often it occurs. The ids go back to
the blocks, where they replace the words at their positions. Decoding joins ids, by a hash table of the vocabulary's ids,
with the table of their pieces, which is as large as the vocabulary and so goes to every task; the pieces stay in order.

A block's words and its texts are found in two passes, as word numbers in place of texts would have to be written and
shuffled, 1.9 times the input in all; both passes must see the same blocks, so an input whose rows may come in another
order, from a shuffle, is written first. Tasks that encode words hold those of one part of the distinct words; parts
grow in number with the input's files, PART bytes of them for each.

Only compressed texts and distinct words are shuffled, never occurrences, so a word that fills a third of the corpus
weighs one row for each block.

Cases: null and empty text have no ids and decode to the empty string. Strings of special tokens inside a text become
those tokens, as the library does by default. Repeated rows give repeated results. Columns other than doc_id and text
are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.arrowtext import release, slices
from strataflow.session import partitions_for, read_table, ship_package, steady

#: The splitter's white space (Unicode White_Space), its pattern, and the same in `re` for settled
#: characters, those whose class has been the same in all Unicode versions of the last decade. Other texts take the
#: library's splitter.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COUNTERS = "²³¹¼½¾〇〡-〩〸-〺"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_{COUNTERS}]+| ?[\d{COUNTERS}]+| ?(?:(?![{COUNTERS}])[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
UNSETTLED = r"[^\x00-\u052f\u2010-\u2027\u20ac\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
BLOCK_BYTES, PART = 16_000_000, 64_000_000

split_settled, unsettled = re.compile(PATTERN).findall, re.compile(UNSETTLED).search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Bpe:
    """A byte-level tokenizer file: splitter, encoder of single words, pieces of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = frozenset(added)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def split(self, text: str) -> list[str]:
        if self.around is not None and self.around.search(text):
            return [w for part in self.around.split(text) if part for w in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if unsettled(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return split_settled(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @cached_property
    def pieces(self) -> pa.Table:
        """id and piece, its bytes."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        out = []
        for i in range(self.size):
            token = self.tokenizer.id_to_token(i) or ""
            out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
        return pa.table({"id": pa.array(range(self.size), pa.uint32()), "piece": pa.array(out, pa.large_binary())})


@lru_cache(2)
def bpe(path: str) -> _Bpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Bpe(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of documents of about BLOCK_BYTES."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for a, b in slices(batch.column("text"), BLOCK_BYTES // 8):
            part = batch.slice(a, b - a)
            ids.append(part.column("doc_id"))
            texts += part.column("text").fill_null("").to_pylist()
            size += part.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts
    release()


def _number(ids: pa.Array, texts: list[str]) -> int:
    h = xxhash.xxh64(repr(ids.to_pylist()).encode(), 7)
    for t in texts:
        h.update(t.encode())
        h.update(b"\xff")
    return h.intdigest() - 2**63


def block_words(path: str, parts: int) -> Callable:
    """The distinct words of each block, numbered in the order of their first places, packed by the part they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = bpe(path).split
        for ids, texts in _blocks(batches):
            words: dict[str, None] = {}
            for t in texts:
                words.update(dict.fromkeys(split(t)))
            raw = [w.encode() for w in words]
            sizes = np.array([len(w) for w in raw], "<i4")
            part = np.array([xxhash.xxh64_intdigest(w) for w in raw], np.uint64) % np.uint64(parts)
            order = np.argsort(part, kind="stable").astype("<i4")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            press, parcels, to = zstandard.ZstdCompressor(level=3), [], []
            for at in np.split(order, cuts) if len(order) else []:
                head = np.array([len(at)], "<i8").tobytes() + at.tobytes() + sizes[at].tobytes()
                parcels.append(press.compress(head + b"".join([raw[i] for i in at.tolist()])))
                to.append(int(part[at[0]]))
            block = pa.array([_number(ids, texts)] * len(parcels), pa.int64())
            yield pa.RecordBatch.from_pydict({"part": pa.array(to, pa.int32()), "block": block, "body": pa.array(parcels, pa.binary())})

    return run


def encode_words(path: str) -> Callable:
    """Encodes each distinct word of a part of the words, and sends its ids to the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            bodies = []
            for parcel in batch.column("body"):
                raw = zstandard.ZstdDecompressor().decompress(parcel.as_py())
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                nth, sizes = np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<i4", n, 8 + 4 * n)
                ends = (np.cumsum(sizes) + 8 + 8 * n).tolist()
                words = [raw[a:b] for a, b in zip([8 + 8 * n, *ends[:-1]], ends, strict=True)]
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(x, "<u4") for x in bpe(path).encode([w.decode() for w in new])), strict=True))
                each = [known[w] for w in words]
                bodies.append(_put(nth, np.array([len(x) for x in each]), np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bodies, pa.binary())], names=["block", "body"])

    return run


def _put(nth: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> bytes:
    """Words' numbers, counts of ids, and ids, as compressed bytes."""
    wide = int(flat.max(initial=0) >= 1 << 16)
    head = np.array([len(nth), wide], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + nth.astype("<i4").tobytes() + lens.astype("<i4").tobytes() + flat.astype("<u4" if wide else "<u2").tobytes())


def _got(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, wide = np.frombuffer(raw, "<i8", 2).tolist()
    return np.frombuffer(raw, "<i4", n, 16), np.frombuffer(raw, "<i4", n, 16 + 4 * n), np.frombuffer(raw, "<u4" if wide else "<u2", -1, 16 + 8 * n).astype("<u4")


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] for each i of at, one after another."""
    n = lens[at]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts[at] - (ends - n), n)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: the documents as one compressed Arrow stream."""
    for ids, texts in _blocks(batches):
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": ids, "text": pa.array(texts, pa.large_string())})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        body = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        yield pa.RecordBatch.from_pydict({"block": pa.array([_number(ids, texts)], pa.int64()), "body": pa.array([body], pa.binary())})


def joined_pieces(ids: np.ndarray, offs: np.ndarray, pieces: pa.Table) -> list[str]:
    """The text of the ids between each two offsets: ids joined with the table of pieces, in their order."""
    at = pc.index_in(pa.array(ids, pa.uint32()), value_set=pieces.column("id").combine_chunks())
    found = pieces.column("piece").combine_chunks().take(at)
    if found.null_count:
        raise ValueError("an id that the vocabulary doesn't have")
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)[offs].tolist()
    data = found.buffers()[2]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded with a column decoded, the text of ids (little-endian unsigned 32-bit integers; null: null)."""
    ship_package(coded.sparkSession)
    path = path or default_path()
    coded = coded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = bpe(path).pieces
        for batch in batches:
            sizes = np.array(pc.binary_length(batch.column("ids")).fill_null(0), np.int64)
            for a, b in _groups(sizes, BLOCK_BYTES // 2):
                part = batch.slice(a, b - a)
                flat = np.frombuffer(b"".join(x for x in part.column("ids").to_pylist() if x), "<u4")
                texts = joined_pieces(flat, np.concatenate(([0], np.cumsum(sizes[a:b]) // 4)), pieces)
                column = pa.array(texts, pa.string())
                if part.column("ids").null_count:
                    column = pc.if_else(part.column("ids").is_valid(), column, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "decoded"])
        release()

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


def _groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes."""
    a, ends = 0, np.cumsum(sizes)
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def code_blocks(path: str) -> Callable:
    """Puts ids at the words' places."""

    def run(packed: pa.Table, words: pa.Table) -> pa.Table:
        coder = bpe(path)
        got = [_got(x.as_py()) for x in words.column("body")]
        total = sum(len(g[0]) for g in got)
        starts, lens = np.zeros(total, np.int64), np.zeros(total, np.int64)
        flat, base = np.concatenate([np.zeros(0, "<u4"), *(g[2] for g in got)]), 0
        for nth, n, ids in got:
            lens[nth], starts[nth] = n, base + np.cumsum(n) - n
            base += len(ids)
        doc_ids, out = [], []
        for blob in packed.column("body"):
            place: defaultdict[str, int] = defaultdict(count().__next__)  # numbers new words as block_words does
            with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())) as r:
                table = r.read_all()
            doc_ids.append(table.column("doc_id").combine_chunks())
            for text in table.column("text"):
                at = np.fromiter(map(place.__getitem__, coder.split(text.as_py())), np.int64)
                out.append(_gather(flat, starts, lens, at).tobytes())
        table = pa.table({"doc_id": pa.chunked_array(doc_ids), "ids": pa.array(out, pa.binary())})
        del got, flat, out
        release()
        return table

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row."""
    ship_package(docs.sparkSession)
    path = path or default_path()
    docs = steady(docs.select("doc_id", "text"), "bpe-input")
    parts = partitions_for(docs, PART)
    words = docs.mapInArrow(block_words(path, parts), "part int, block long, body binary").repartitionById(parts, F.col("part"))
    coded = words.mapInArrow(encode_words(path), "block long, body binary")
    packed = docs.mapInArrow(_packed, "block long, body binary")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])
    # in as many parts as there are of words, whose number grows with the input
    packed, coded = (x.repartition(parts, "block") for x in (packed, coded))
    return packed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(code_blocks(path), schema)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return digests(decode(encode(read_table(spark, sf_dir, "documents"), path), path))
