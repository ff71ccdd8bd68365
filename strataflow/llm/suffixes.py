"""Removal of long repeats by sorting suffixes in two stages.

A byte goes if a string of WIDTH bytes that covers it also starts earlier, in a document of smaller id or earlier in
the same one. Only strings that may repeat are sorted. Each string of WIDTH bytes has an anchor, the GRAM-byte run in
it whose hash is least (the first of these), which depends on the string alone; so strings that are equal have equal
anchors, and an anchor that occurs once rules out a repeat of all strings that it is the anchor of. The others' strings
go, grouped by anchor, to tasks that sort them: those suffixes that are smaller than their successors are sorted
directly, the rest are induced by scanning the buckets of first bytes in order, and the lengths of adjacent common
prefixes tell which strings are equal. The first of equals stays.

Runs of text that a task holds twice are sent once, and what is known to repeat by then goes as runs of strings. The
strings of an anchor with more than HOT places are grouped by more than the anchor: those in which it lies at one of
STEP neighbouring offsets share a core of WIDTH - STEP + 1 bytes, and are grouped by that. Equal strings have their
anchor at the same offset, so they share a core; and a group's strings differ in STEP - 1 bytes at most, so its distinct
ones stay few however often the anchor occurs. All groups are sorted alike. Text is shuffled once; both joins read that
shuffle.

Cases: null text is empty. Texts under WIDTH bytes lose nothing. A text equal to one of smaller id loses all its bytes
(if it has WIDTH). Rows with equal doc_id and text are one document and have equal results; different texts of one
doc_id count as documents in the order of a hash. A null doc_id comes before all others; a doc_id that is no integer is
refused. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.arrowtext import mix, release, slices, utf8
from strataflow.session import materialise, read_table, ship_package

#: Bytes of a repeat, bytes of an anchor, places from which an anchor's strings are grouped by cores, offsets of a core.
WIDTH, GRAM, HOT, STEP = 100, 24, 2_000, 4
#: Bytes sorted at a time, about; raw bytes of contexts that a task gathers before it sends them; raw bytes of contexts
#: that a sorting task gets, about, and of one context on average.
CHUNK, GATHER, PART, CONTEXT = 1_000_000, 12_000_000, 256_000_000, 140
#: The place of a null doc_id.
FIRST = -(2**63)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes."""
    power, width, part = np.uint64(0x9E3779B97F4A7C15), 1, data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if k & width:
            n = len(data) - k + 1
            piece = part[done : done + n]
            with np.errstate(over="ignore"):
                out = piece.copy() if out is None else out * power + piece
            done += width
        if done == k:
            return mix(out)
        with np.errstate(over="ignore"):
            part = part[:-width] * power + part[width:]
            power = power * power
        width *= 2


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, the first string that it is the anchor of, how many there are, and the anchor's place."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    h = grams(data, gram)
    low = np.uint64(0xFFFFFFFF)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, need = 1, width - gram + 1
    while span * 2 <= need:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < need:
        best = np.minimum(best[: n], best[need - span : need - span + n])
    owner = (best & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return h[owner[first]], first, np.diff(np.append(first, n)), owner[first]


def two_stage_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Positions of `starts`, and of some helpers, in the order of their first `width` bytes.

    text holds contexts that end before `ends`; starts are ascending, and each has width bytes in its context.
    Suffixes smaller than their successors (A) are sorted directly; the others (B) are induced.
    """
    n = len(text)
    kind = np.zeros(n, np.int8)
    np.sign(text[:-1].astype(np.int16) - text[1:], out=kind[:-1], casting="unsafe")
    kind[ends - 1] = -1
    told = np.where(kind != 0, np.arange(n), n)
    is_b = kind[np.minimum.accumulate(told[::-1])[::-1]] > 0
    # a start's successors up to the first of kind A must be there to induce it
    next_a = np.minimum.accumulate(np.where(is_b, n, np.arange(n))[::-1])[::-1]
    lasts = starts[np.append(starts[1:] != starts[:-1] + 1, True)]
    lasts = lasts[is_b[lasts]]
    more = next_a[lasts] - lasts
    helpers = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + np.repeat(lasts + 1, more)
    place = np.union1d(starts, helpers)
    char, b = text[place], is_b[place]
    before = np.full(len(place), -1)
    before[1:][place[1:] == place[:-1] + 1] = np.flatnonzero(place[1:] == place[:-1] + 1)
    direct = np.flatnonzero(~b)
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    keys = np.ascontiguousarray(sliding_window_view(padded, width)[place[direct]]).view(f"S{width}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    bound = np.searchsorted(char[direct], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(c): [] for c in np.unique(char)}
    out = []
    for c, induced in waiting.items():
        cur = np.concatenate(induced) if induced else direct[:0]
        parts = []
        while len(cur):
            parts.append(cur)
            cur = before[cur]
            cur = cur[cur >= 0]
            cur = cur[b[cur] & (char[cur] == c)]
        a = direct[bound[c] : bound[c + 1]]
        # a directly sorted suffix's predecessors of the same byte are of kind A
        whole = np.concatenate((*parts, a))
        out.append(whole)
        p = before[whole]
        p = p[p >= 0]
        p = p[b[p] & (char[p] > c)]
        p = p[np.argsort(char[p], kind="stable")]
        for piece in np.split(p, np.flatnonzero(np.diff(char[p])) + 1) if len(p) else []:
            waiting[int(char[piece[0]])].append(piece)
    return place[np.concatenate(out)]


def common_prefixes(text: np.ndarray, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Length, width at most, of the common prefix of each place's string and the one before it; 0 for the first."""
    view, out = sliding_window_view(text, width), np.zeros(len(places), np.int64)
    for a in range(1, len(places), 65_536):
        b = min(len(places), a + 65_536)
        other = view[places[a - 1 : b - 1]] != view[places[a:b]]
        at = other.argmax(axis=1)
        out[a:b] = np.where(other[np.arange(b - a), at], at, width)
    return out


def repeats(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether each start's string equals that of a start of lesser rank."""
    if not len(starts):
        return np.zeros(0, bool)
    of = np.full(len(text), -1)
    of[starts] = np.arange(len(starts))
    order = of[two_stage_order(text, starts, ends, width)]
    order = order[order >= 0]
    heads = np.flatnonzero(common_prefixes(text, starts[order], width) < width)
    least = np.repeat(np.minimum.reduceat(rank[order], heads), np.diff(np.append(heads, len(order))))
    out = np.zeros(len(starts), bool)
    out[order] = rank[order] > least
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and key, which together tell rows apart by 128 bits, with doc_id and text."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.xxhash64("doc_id", text).alias("key"), "doc_id", text.alias("text"))


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    """hash, doc, key, at (first string << 14 | number of strings - 1 << 7 | the anchor's place in it) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy() for c in ("doc", "key"))
            for a, b in slices(batch.column("text")):
                data, offs = utf8(batch.column("text").slice(a, b - a))
                found = [anchors(data[i:j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                n = [len(x[0]) for x in found]
                h, first, count, place = (np.concatenate([x[c] for x in found]) for c in range(4))
                yield pa.RecordBatch.from_pydict({"hash": h.view(np.int64), "doc": np.repeat(docs[a:b], n), "key": np.repeat(keys[a:b], n), "at": first << 14 | count - 1 << 7 | place - first})

    return keyed.select("doc", "key", "text").mapInArrow(run, "hash long, doc long, key long, at long")


def pieces(data: bytes, first: int, count: int, place: int) -> Iterator[tuple[int, int, bytes]]:
    """Route, first string and body of the strings first, first + 1, ... with one anchor, by the core that they share."""
    string = first
    while string < first + count:
        nth = (place - string) // STEP
        last = min(first + count - 1, place - nth * STEP)
        core = data[place - nth * STEP : place - nth * STEP + WIDTH - STEP + 1]
        yield xxhash.xxh64_intdigest(core, nth) - 2**63, string, data[string : last + WIDTH]
        string = last + 1


class _Parcels:
    """Contexts on their way to the tasks that sort them, packed by task."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []  # route, doc, key, first
        self.known: list[tuple[int, int, int, int]] = []  # doc, key, first, count
        self.size = 0

    def add(self, route: int, doc: int, key: int, first: int, body: bytes) -> None:
        """A context whose strings all start from `first` on; one that was here before goes only in the earlier place."""
        here = (doc, key, first)
        i = self.seen.get(body)
        if i is None:
            self.seen[body] = len(self.rows)
            self.rows.append((route, *here))
            self.size += len(body) + 32
            return
        other = self.rows[i][1:]
        if here < other:
            self.rows[i] = (self.rows[i][0], *here)
        if here != other:
            self.known.append((*max(here, other), len(body) - WIDTH + 1))

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.rows or self.known:
            rows = np.array(self.rows, np.int64).reshape(-1, 4)
            bodies = list(self.seen)
            to = (rows[:, 0].view(np.uint64) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            press = zstandard.ZstdCompressor(level=3)
            routes, out = [], []
            for at in np.split(order, cuts) if len(order) else []:
                at = at[np.argsort(rows[at, 0], kind="stable")]
                routes.append(int(to[at[0]]))
                out.append(press.compress(pickle.dumps(([rows[at, c] for c in range(4)], [len(bodies[i]) for i in at.tolist()], b"".join([bodies[i] for i in at.tolist()])))))
            if self.known:
                runs = _runs(np.array(self.known, np.int64))
                routes.append(int(runs[0, 1] % self.parts))
                out.append(press.compress(pickle.dumps(runs)))
            yield pa.RecordBatch.from_pydict({"route": pa.array(routes, pa.int32()), "body": pa.array(out, pa.binary())})
        self.clear()


def _runs(found: np.ndarray) -> np.ndarray:
    """doc, key, first string and number of strings, with what adjoins or overlaps made one."""
    if not len(found):
        return found.reshape(-1, 4)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    doc = np.cumsum(np.concatenate(([0], (np.diff(found[:, :2], axis=0) != 0).any(axis=1))))
    end = found[:, 2] + found[:, 3]
    # ends so far, by document: documents are set apart by more than any text is long
    apart = doc * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    heads = np.flatnonzero(np.concatenate(([True], (found[1:, 2] + apart[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))))
    tails = np.append(heads[1:], len(found)) - 1
    out = found[heads].copy()
    out[:, 3] = reach[tails] - apart[tails] - out[:, 2]
    return out


def _contexts(parts: int) -> Callable:
    """From (doc, key, text, notes) to parcels; notes: anchors, and a place of -1 in the first of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels = _Parcels(parts)
        for batch in batches:
            for doc, key, text, notes in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), batch.column("notes"), strict=True):
                fields = [np.array(notes.values.field(c)) for c in ("at", "hash", "hot")]
                if not (fields[0] < 0).any():
                    continue
                data = text.as_buffer().to_pybytes()
                for at, h, hot in zip(*(x.tolist() for x in fields), strict=True):
                    if at < 0:
                        continue
                    first, count = at >> 14, (at >> 7 & 127) + 1
                    if not hot:
                        parcels.add(h, doc, key, first, data[first : first + count + WIDTH - 1])
                        continue
                    for route, string, body in pieces(data, first, count, first + (at & 127)):
                        parcels.add(route, doc, key, string, body)
                if parcels.size >= GATHER or len(parcels.known) >= GATHER // 32:
                    yield from parcels.send()
        yield from parcels.send()
        release()

    return run


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a task's parcels to doc, key, first and count of runs of strings that repeat an earlier one."""
    seen: dict[bytes, tuple[int, int, int, int]] = {}
    late: list[tuple[int, int, int, int]] = []
    for batch in batches:
        for parcel in batch.column("body"):
            got = pickle.loads(zstandard.ZstdDecompressor().decompress(parcel.as_py()))
            if isinstance(got, np.ndarray):
                yield _verdicts(got)
                continue
            rows, sizes, joined = got
            end = 0
            for route, doc, key, first, size in zip(*(r.tolist() for r in rows), sizes, strict=True):
                body, end = joined[end : end + size], end + size
                here, other = (doc, key, first, route), seen.get(body)
                if other is None or here < other:
                    seen[body] = here
                if other is not None and here != other:
                    late.append((*max(here, other)[:3], size - WIDTH + 1))
    if late:
        yield _verdicts(_runs(np.array(late, np.int64)))
    del late
    bodies = list(seen)
    rows = np.array(list(seen.values()), np.int64).reshape(-1, 4)
    order = np.argsort(rows[:, 3], kind="stable")
    routes = rows[order, 3]
    heads = np.flatnonzero(np.concatenate(([True], routes[1:] != routes[:-1]))) if len(routes) else order
    chunk: list[int] = []
    held = 0
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True) if len(routes) else ():
        if b - a < 2:
            continue  # no two strings of one body are equal: they have their one anchor at different offsets
        group = order[a:b].tolist()
        chunk += group
        held += sum(len(bodies[i]) for i in group)
        if held >= CHUNK:
            yield _chunk_verdicts(chunk, bodies, rows)
            chunk, held = [], 0
    if chunk:
        yield _chunk_verdicts(chunk, bodies, rows)
    del seen, bodies
    release()


def _chunk_verdicts(chunk: list[int], bodies: list[bytes], rows: np.ndarray) -> pa.RecordBatch:
    text = np.frombuffer(b"".join([bodies[i] for i in chunk]), np.uint8)
    sizes = np.array([len(bodies[i]) for i in chunk])
    ends = np.cumsum(sizes)
    n = sizes - WIDTH + 1
    nth = np.repeat(np.arange(len(chunk)), n)
    within = np.arange(len(nth)) - np.repeat(np.cumsum(n) - n, n)
    starts = (ends - sizes)[nth] + within
    place = np.array(chunk)
    dup = repeats(text, starts, ends, _rank(rows[place[nth], 0], rows[place[nth], 1], rows[place[nth], 2] + within))
    hit = np.flatnonzero(dup)
    at = place[nth[hit]]
    return _verdicts(_runs(np.stack((rows[at, 0], rows[at, 1], rows[at, 2] + within[hit], np.ones(len(hit), np.int64)), axis=1)))


def _rank(*fields: np.ndarray) -> np.ndarray:
    """Rank by fields, the first foremost; equal where all are."""
    order = np.lexsort(fields[::-1])
    step = np.zeros(len(order), bool)
    for f in fields:
        step[1:] |= f[order][1:] != f[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _verdicts(runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(np.ascontiguousarray(runs[:, i])) for i, c in enumerate(("doc", "key", "at", "n"))})


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, kept, n_bytes, n_removed, n_spans of each text; notes: repeats, and -1 in the first of equal texts."""
    for batch in batches:
        for i, j in slices(batch.column("text")):
            yield _stripped(batch.slice(i, j - i))
    release()


def _stripped(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept, counts = [], []
    for text, notes in zip(batch.column("text"), batch.column("notes"), strict=True):
        raw = text.as_buffer()
        n = len(raw)
        at, count = (np.array(notes.values.field(c)) if notes.is_valid else np.zeros(0, np.int64) for c in ("at", "n"))
        if not (at < 0).any():  # equal to an earlier text
            gone = n >= WIDTH
            kept.append(b"" if gone else raw.to_pybytes())
            counts.append((n, n if gone else 0, int(gone)))
            continue
        at, count = at[at >= 0], count[at >= 0]
        if not len(at):
            kept.append(raw.to_pybytes())
            counts.append((n, 0, 0))
            continue
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + count + WIDTH - 1, -1)
        drop = np.cumsum(cover[:-1]) > 0
        kept.append(np.frombuffer(raw, np.uint8)[~drop].tobytes())
        counts.append((n, int(drop.sum()), int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())))
    columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *columns], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans of each row."""
    spark = docs.sparkSession
    ship_package(spark)
    keyed = _keyed(docs)
    same = ["doc", "key"]
    rows = _anchor_rows(keyed)
    # written, so that both sides of the join below are plain exchanges, of which Spark splits a frequent anchor's part
    often = materialise(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "suffix-often")
    places = often.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places * CONTEXT // PART))
    firsts = keyed.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("_sha")).agg(F.min(F.struct(*same)).alias("_first")).select("_first.*")
    firsts = materialise(firsts, "suffix-firsts")
    note = firsts.select(*same, F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("hash"), F.lit(False).alias("hot")).alias("note"))
    suspects = rows.join(often.select("hash", (F.col("n") > HOT).alias("hot")), "hash").select(*same, F.struct("at", "hash", "hot").alias("note")).unionByName(note)
    noted = suspects.groupBy(*same).agg(F.collect_list("note").alias("notes")).where(F.size("notes") > 1)
    # doc_id only so that the exchange of texts is the one that `whole` needs
    parcels = keyed.join(noted, same).select(*same, "doc_id", "text", "notes").mapInArrow(_contexts(parts), "route int, body binary")
    found = parcels.repartitionById(parts, F.col("route")).mapInArrow(_sorted_groups, "doc long, key long, at long, n long")
    first = firsts.select(*same, F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    spans = found.unionByName(first).groupBy(*same).agg(F.collect_list(F.struct("at", "n")).alias("notes"))
    whole = keyed.join(spans, same, "left").select("doc_id", "text", "notes")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(_strip, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for op9_suffix_dedup, of all strings of all texts: for small tables, with a doc_id that is there once.
ORACLE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 99)) AS p FROM d)),
 f AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS first FROM w GROUP BY s HAVING count(*) > 1),
 r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE struct_pack(d := doc_id, p := p) > first WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM r) GROUP BY doc_id, n),
 g AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY doc_id),
 e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM i UNION ALL SELECT doc_id, max(b), 2000000000 FROM i GROUP BY doc_id),
 k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""
