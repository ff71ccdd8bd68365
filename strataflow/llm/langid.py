"""Language identification with spans of mixed-language text.

A word's script, read from ranges of code points, narrows the languages it may be in to those that training texts
write in that script. Each of them scores the word by hashed character n-grams and the word as a whole; a Viterbi pass
over a text's words, with a penalty for each switch, labels spans. The language with the most letters is the text's.

Long texts are cut into pieces of PIECE words, whose best paths are found for every language to begin in and then
chained, so the labelling is that of one pass over the whole text. Where there are so many languages that this would
take more than CELLS cells, texts are labelled in one pass each, word by word, side by side. There may be 32,767
languages.

Training takes at most PER_LANG texts of each language (by hash order), a documented bound; predictions cover all rows.

Cases: null text, and text without a letter, is `und` with score 0 and no spans; so is every text if there is nothing
to learn from. A null doc_id isn't held out. Ties go to the language that sorts first. Repeated rows give repeated
results; an empty table gives an empty one. Only text is ever used to predict.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.arrowtext import mix, release, slices
from strataflow.session import read_table, ship_package

PER_LANG = 2_000
BUCKETS = 1 << 15
PENALTY = 12.0
PIECE = 512
CELLS = 1 << 26
KINDS = 4  # character pairs, triples and quadruples, whole words

#: Script ranges, as first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@lru_cache
def _characters() -> np.ndarray:
    """0 for what isn't a letter, 1 for letters of no listed script, from 2 on the script."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for i, ranges in enumerate(SCRIPTS.values(), 2):
        for a, b in ranges:
            out[a : b + 1][out[a : b + 1] > 0] = i
    return out


def _words(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The words of some texts: starts, ends (in code points of all texts joined by a line end), script, document bounds, n-gram buckets."""
    lowered = [(t or "").lower() for t in texts]
    cp = np.frombuffer("\n".join(["", *lowered, "", ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _characters()[cp]
    letter = script > 0
    x = np.where(letter, cp, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    starts = at[~letter[at - 1]] if len(at) else at
    ends = at[~letter[at + 1]] + 1 if len(at) else at
    one, two, three = x[at - 1], x[at], x[at + 1]
    pair = mix(two * np.uint64(0x1F123BB5) + one + np.uint64(1 << 40))
    triple = mix(pair + three * np.uint64(0x9E3779B1) + np.uint64(2 << 40))
    quad = mix(triple + np.where(one > 0, x[at - 2], 0) * np.uint64(0x85EBCA77) + np.uint64(3 << 40))
    first = np.searchsorted(at, starts)
    whole = mix(np.add.reduceat(mix(two + (np.uint64(1) << np.uint64(24)) * (at - np.repeat(starts, ends - starts)).astype(np.uint64)), first)) if len(at) else pair
    grams = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in (pair, triple, quad)])
    places = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    return {"starts": starts, "ends": ends, "first": first, "script": script[starts], "grams": grams, "whole": (whole % np.uint64(BUCKETS)).astype(np.int32), "docs": np.searchsorted(starts, places), "places": places}


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    grams, scripts = np.zeros((KINDS, BUCKETS)), np.zeros(len(SCRIPTS) + 2)
    w = _words(texts)
    for k in range(KINDS - 1):
        grams[k] += np.bincount(w["grams"][k], minlength=BUCKETS)
    grams[KINDS - 1] += np.bincount(w["whole"], minlength=BUCKETS)
    return grams, scripts + np.bincount(w["script"], minlength=len(scripts))


class Model:
    """Languages, their scores for n-gram buckets, and the scripts that they use."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        order = np.argsort(np.array(langs, object)) if langs else []
        self.langs = [langs[i] for i in order]
        grams, scripts = grams[order], scripts[order]
        p = (grams + 0.5) / (grams + 0.5).sum(axis=2, keepdims=True) if len(langs) else grams
        self.tables = np.ascontiguousarray(np.log(p).transpose(1, 2, 0), dtype=np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= 1e-3).T
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, w: dict[str, np.ndarray]) -> np.ndarray:
        if not len(w["starts"]):
            return np.zeros((0, len(self.langs)), np.float32)
        letters = self.tables[0][w["grams"][0]]
        for k in (1, 2):
            letters += self.tables[k][w["grams"][k]]
        s = np.add.reduceat(letters, w["first"], axis=0) / 3 + self.tables[3][w["whole"]]
        s -= s.max(axis=1, keepdims=True)
        s[~self.allowed[w["script"]]] -= 1e4
        return s


def viterbi(s: np.ndarray, docs: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of s under a penalty for each change within a document; docs: n + 1 offsets."""
    n, k = s.shape
    if not n:
        return np.zeros(0, np.int16)
    if n * k * k > CELLS:
        return _one_pass(s, docs, penalty)
    sizes = np.diff(docs)
    pieces = -(-sizes // PIECE)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = docs[doc] + nth * PIECE
    size = np.minimum(PIECE, docs[doc + 1] - start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # pieces longer than t
    # v[piece, entered from, now in]
    v = np.where(np.eye(k, dtype=bool), 0.0, -1e9)[None].repeat(len(size), 0)
    back = []
    for t in range(int(size[0])):
        m = live[t]
        best = v[:m].argmax(axis=2)
        jump = np.take_along_axis(v[:m], best[:, :, None], 2) - penalty
        stay = v[:m] >= jump
        back.append(np.where(stay, np.arange(k, dtype=np.int16), best[:, :, None].astype(np.int16)))
        v[:m] = np.where(stay, v[:m], jump) + s[start[:m] + t][:, None, :]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))  # a piece's row in v
    begin = np.cumsum(pieces) - pieces
    full = np.flatnonzero(pieces)
    value, came = np.zeros((len(sizes), k)), np.zeros((len(doc), k), np.int16)
    for i in range(int(pieces.max())):
        d = full[pieces[full] > i]
        total = value[d][:, :, None] + v[where[begin[d] + i]]
        came[begin[d] + i] = total.argmax(axis=1)
        value[d] = total.max(axis=1)
    state = value.argmax(axis=1)
    end = np.zeros(len(doc), np.int64)
    for i in range(int(pieces.max()) - 1, -1, -1):
        d = full[pieces[full] > i]
        end[begin[d] + i] = state[d]
        state[d] = came[begin[d] + i, state[d]]
    entered = came[np.arange(len(doc)), end][order].astype(np.int64)
    now, out = end[order], np.empty(n, np.int16)
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        out[start[:m] + t] = now[:m]
        now[:m] = back[t][np.arange(m), entered[:m], now[:m]]
    return out


def _one_pass(s: np.ndarray, docs: np.ndarray, penalty: float) -> np.ndarray:
    """As viterbi; holds a bit for each word and label, and a label for each word."""
    n, k = s.shape
    size = np.diff(docs)
    order = np.argsort(-size, kind="stable")
    start, size = docs[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts longer than t
    v = np.zeros((len(size), k))
    stays, bests = [], []
    for t in range(int(size[0])):
        m = live[t]
        best = v[:m].argmax(axis=1)
        jump = v[:m].max(axis=1, keepdims=True) - penalty
        stay = v[:m] >= jump
        stays.append(np.packbits(stay, axis=1))
        bests.append(best.astype(np.int16))
        v[:m] = np.where(stay, v[:m], jump) + s[start[:m] + t]
    now, out = v.argmax(axis=1), np.empty(n, np.int16)
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        here = now[:m]
        out[start[:m] + t] = here
        kept = stays[t][np.arange(m), here >> 3] >> (7 - (here & 7)) & 1
        now[:m] = np.where(kept, here, bests[t])
    return out


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learns from text and lang of rows that aren't held out, at most per_lang for each language."""
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # a threshold on the hash leaves about twice the bound, so no task meets more of a frequent language
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), 2 * per_lang / F.count("*")).alias("_share"))
    near = rows.join(F.broadcast(sizes), "lang").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sample = near.withColumn("_n", nth).where(F.col("_n") <= per_lang).select("lang", "text")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, scripts = np.zeros((KINDS, BUCKETS)), np.zeros(len(SCRIPTS) + 2)
        column = table.column("text").cast(pa.large_string()).combine_chunks()
        for a, b in slices(column, 2_000_000):
            g, c = _counts(column.slice(a, b - a).to_pylist())
            grams, scripts = grams + g, scripts + c
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "body": pa.array([pickle.dumps((grams.astype(np.float32), scripts))], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(count, "lang string, body binary").collect()  # a row for each language
    counts = [pickle.loads(bytes(r["body"])) for r in found]
    grams = np.stack([c[0] for c in counts]) if counts else np.zeros((0, KINDS, BUCKETS))
    scripts = np.stack([c[1] for c in counts]) if counts else np.zeros((0, len(SCRIPTS) + 2))
    return Model([r["lang"] for r in found], grams, scripts)


def label(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[list[str], list[float], list[str]]:
    """Language, share of letters in it, and spans start:end:language (code points of the lower-cased text) of each text."""
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
    w = _words(texts)
    path = viterbi(model.word_scores(w), w["docs"], penalty)
    n, k = len(texts), len(model.langs)
    docs = w["docs"]
    doc = np.repeat(np.arange(n), np.diff(docs))
    letters = np.bincount(doc * k + path, (w["ends"] - w["starts"]).astype(float), n * k).reshape(n, k)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    score = np.where(total > 0, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
    turn = np.ones(len(path), bool)
    turn[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(turn)
    until = np.append(at[1:], len(path))[: len(at)] - 1
    spans: list[list[str]] = [[] for _ in texts]
    base = w["places"][doc[at]] if len(at) else at
    for d, a, b, i in zip(doc[at].tolist(), (w["starts"][at] - base).tolist(), (w["ends"][until] - base).tolist(), path[at].tolist(), strict=True):
        spans[d].append(f"{a}:{b}:{model.langs[i]}")
    return [model.langs[i] if t else "und" for i, t in zip(best, total, strict=True)], score.tolist(), [",".join(x) for x in spans]


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            for a, b in slices(batch.column("text"), 2_000_000):
                part = batch.slice(a, b - a)
                lang, score, spans = label(part.column("text").to_pylist(), own, penalty)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "spans"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans string")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every document."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
