"""Personal data by patterns of form, and by contexts that these bootstrap.

The base kinds (email, ip, card, phone) are found by their form. Each find, and each other token that looks like an
identifier, votes in a graph of contexts (the words around) and instances (the strings): in each round, contexts whose
known instances are mostly of one kind are trusted, and the unknown instances in them take that kind for good and vote
in the next round, until a round learns nothing. Known instances of other kinds count in full against a context; u
unknown ones only as UNKNOWN * log2(1 + u), so that a context may hold many, but with more support.

Trusted contexts then look for plain instances too: any token, and any run of up to RUN tokens with single spaces
between, in such a context is an instance that votes. It takes the context's kind only if the known instances there are
at least PLAIN of all distinct ones, as most words in most contexts are no identifiers. Contexts that come to be trusted
by that are looked for in turn, until there are no more. Finds by context are added to the base spans, never replacing
one: plain instances in the contexts that they were found in, others wherever they occur; of a find within another the
longer.

A token looks like an identifier if it has 5 characters and 4 digits at least, and so does a run of numbers with single
spaces between, if it has 7 digits. Context words are runs of ASCII letters and digits and of other characters beyond
ASCII, of any length, that lie wholly beside the mention. Texts are searched whole, in time linear in their length.
Contexts are known by 64 bits of their words' hashes, instances by 128 bits.

Cases: null and empty text have no spans. Rows with equal doc_id and text have equal results, and weigh once in the
graph, which counts distinct instances. Matches that fail a condition are dropped without retry. An empty table gives
an empty result. Other columns are not carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.arrowtext import mix, release, slices, tokens, utf8
from strataflow.session import cut, materialise, read_table, ship_package

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, UNKNOWN, PLAIN, RUN = 5, 0.9, 0.1, 0.5, 4
PREFIX_BITS = 24

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[0-9][0-9().\-/]*(?:\x20\(?[0-9][0-9().\-/]*)+")
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32], np.uint8)
_TRIM = " \t\r\n.,;:!?()[]{}<>\"'|#$%&*"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1 if m is None else m.end())


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time, of each longest chain of dotted numbers; parts of at most 255."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                yield four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by form, by kind as listed and then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _beside(found: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What overlaps none of the spans taken, in one sweep."""
    taken = sorted(taken)
    starts, reach = [p for p, _ in taken], [0, *accumulate((q for _, q in taken), max)]
    for i, j in found:
        if reach[bisect_left(starts, j)] <= i:
            yield i, j


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _TRIM:
        a += 1
    while a < b and text[b - 1] in _TRIM:
        b -= 1
    return a, b


def _digit_tokens(text: str) -> Iterator[tuple[int, int]]:
    until = 0
    for m in _NUMBER.finditer(text):
        if m.start() < until:
            continue
        a, b = m.start(), m.end()
        while a > until and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        until = b
        a, b = _trimmed(text, a, b)
        if b - a >= 5 and len(_DIGIT.findall(text, a, b)) >= 4:
            yield a, b


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens, and runs of numbers, that look like identifiers."""
    runs = [_trimmed(text, *m.span()) for m in _NUMBERS.finditer(text)]
    runs = [(a, b) for a, b in runs if len(_DIGIT.findall(text, a, b)) >= 7]
    return sorted([*runs, *_beside(_digit_tokens(text), runs)])


def _instance(raw: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(raw.lower())


def _pattern(first: np.ndarray, second: np.ndarray, which: int) -> np.ndarray:
    return mix(mix(first * np.uint64(0x9E3779B97F4A7C15) + second) + np.uint64(which))


class _Text:
    """Bytes and words of one text; places are counted in code points outside, in bytes inside."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray):
        self.data, self.starts, self.ends, self.hashes = data, starts, starts + lens, hashes
        self.lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

    def raw(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()

    def contexts(self, spans: list[tuple[int, int]]) -> list[list[int]]:
        """Patterns around each span: the two words before it, and the words before and after."""
        at = self.lead[np.array(spans, np.int64).reshape(-1, 2)]
        before, after = np.searchsorted(self.ends, at[:, 0], "right"), np.searchsorted(self.starts, at[:, 1], "left")
        return [[int(p) for p in ps if p is not None] for ps in zip(*self._patterns(before, after), strict=True)]

    def _patterns(self, before: np.ndarray, after: np.ndarray) -> tuple[list, list]:
        n, h = len(self.hashes), np.append(self.hashes, np.zeros(2, np.uint64))
        two = _pattern(h[before - 2], h[before - 1], 1).view(np.int64).tolist()
        around = _pattern(h[before - 1], h[np.minimum(after, n)], 2).view(np.int64).tolist()
        return [p if i >= 2 else None for p, i in zip(two, before.tolist(), strict=True)], [p if i >= 1 and j < n else None for p, i, j in zip(around, before.tolist(), after.tolist(), strict=True)]


def _texts(column: pa.Array) -> Iterator[_Text]:
    """The texts of a column; words are found for many of them at once."""
    data, offs = utf8(column)
    starts, lens, h, kind, docs = tokens(data, offs)
    word = kind == 1
    docs = np.concatenate(([0], np.cumsum(word)))[docs]
    starts, lens, h = starts[word], lens[word], h[word]
    for i in range(len(offs) - 1):
        a, b = docs[i], docs[i + 1]
        yield _Text(data[offs[i] : offs[i + 1]], starts[a:b] - offs[i], lens[a:b], h[a:b])


_MENTION = "array<struct<start:int,end:int,kind:string,instance:string,patterns:array<bigint>>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))]))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that tell rows apart."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id").alias("key2"), "text")


def mentions(rows: DataFrame) -> DataFrame:
    """doc_id, key, key2, base (kind:start:end, ...) and mentions of each row: base finds and other tokens, with their patterns."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 4_000_000):
                part = batch.slice(a, b - a)
                base, found = [], []
                for text, own in zip(part.column("text").fill_null("").to_pylist(), _texts(part.column("text")), strict=True):
                    spans = base_spans(text)
                    base.append(",".join(f"{k}:{i}:{j}" for k, i, j in spans))
                    taken = [(i, j) for _, i, j in spans]
                    spans += [(None, i, j) for i, j in _beside(candidates(text), taken)]
                    places = [(i, j) for _, i, j in spans]
                    patterns = own.contexts(places) if places else []
                    found.append([{"start": i, "end": j, "kind": k, "instance": _instance(text[i:j].encode()), "patterns": p} for (k, i, j), p in zip(spans, patterns, strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "key2")), pa.array(base, pa.string()), pa.array(found, _ARROW)], names=["doc_id", "key", "key2", "base", "mentions"])
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, key long, key2 long, base string, mentions {_MENTION}")


def _runs_of_tokens(own: _Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every run of k tokens with single spaces between; a token without a word is none."""
    space = np.isin(own.data, _SPACES)
    of = np.cumsum(~space & np.concatenate(([True], space[:-1])))[own.starts]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
    last = np.append(first[1:], len(of)) - 1 if len(of) else of
    if len(first) < k:
        return first[:0], last[:0]
    # from each token to the next: one space, and no other white space
    gaps = np.cumsum(space + 2 * (space & (own.data != 32)))
    single = (gaps[own.starts[first[1:]]] - gaps[own.ends[last[:-1]] - 1] == 1) & (of[first[1:]] - of[last[:-1]] == 1)
    broken = np.concatenate(([0], np.cumsum(~single)))
    ok = broken[k - 1 :] == broken[: len(broken) - k + 1]
    return first[: len(first) - k + 1][ok], last[k - 1 :][ok]


def plain_mentions(rows: DataFrame, bits: bytes) -> DataFrame:
    """key, key2, start, end, instance, pattern of tokens and runs of tokens in contexts whose hash prefix has its bit set."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def hit(table: np.ndarray, patterns: list) -> np.ndarray:
        p = np.array([x or 0 for x in patterns], np.int64).view(np.uint64) >> np.uint64(64 - PREFIX_BITS)
        return (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & np.array([x is not None for x in patterns], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for a, b in slices(batch.column("text"), 4_000_000):
                part = batch.slice(a, b - a)
                at, out = [], []
                for i, own in enumerate(_texts(part.column("text"))):
                    found = {}
                    for k in range(1, RUN + 1):
                        first, last = _runs_of_tokens(own, k)
                        if not len(first):
                            break
                        for patterns in own._patterns(first, last + 1)[0 if k == 1 else 1 :]:
                            for j in np.flatnonzero(hit(table, patterns)).tolist():
                                found.setdefault((int(own.starts[first[j]]), int(own.ends[last[j]])), []).append(patterns[j])
                    if not found:
                        continue
                    text = own.raw(0, len(own.data)).decode("utf-8", "surrogatepass")
                    place = np.searchsorted(own.lead, np.array(list(found), np.int64))
                    byte = {(int(x), int(y)): k for (x, y), k in zip(place.tolist(), found, strict=True)}
                    taken = [(x, y) for _, x, y in base_spans(text)] + candidates(text)
                    for x, y in _beside(iter(byte), taken):
                        for p in found[byte[x, y]]:
                            at.append(i)
                            out.append((x, y, _instance(own.raw(*byte[x, y])), p))
                rows_at = pa.array(at, pa.int64())
                columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows_at), part.column("key2").take(rows_at), *columns], names=["key", "key2", "start", "end", "instance", "pattern"])
        release()

    return rows.select("key", "key2", "text").mapInArrow(run, "key long, key2 long, start int, end int, instance string, pattern long")


def trusted(edges: DataFrame, learned: DataFrame | None, support: int = SUPPORT, confidence: float = CONFIDENCE, plain: float = PLAIN) -> tuple[DataFrame, DataFrame]:
    """Edges with the kinds learned; pattern, _kind, _trust and _plain (trusted with plain instances) of trusted patterns."""
    known = edges if learned is None else edges.join(learned.withColumnRenamed("kind", "_kind"), "instance", "left").select("pattern", "instance", F.coalesce("kind", "_kind").alias("kind"), "plain")
    votes = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    n = F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)
    scored = votes.groupBy("pattern").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("_kind"), F.max(n).alias("best"), F.sum(n).alias("known"), F.sum(F.col("n") - n).alias("unknown"))
    trust = F.col("best") / (F.col("known") + UNKNOWN * F.log2(1 + F.col("unknown")))
    good = scored.where(F.col("best") >= support).withColumn("_trust", trust).where(F.col("_trust") >= confidence)
    return known, good.select("pattern", "_kind", "_trust", (F.col("best") >= plain * (F.col("known") + F.col("unknown"))).alias("_plain"))


def bootstrap(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, plain: float = PLAIN) -> DataFrame:
    """instance and kind of the unknown instances that trusted patterns hold.

    found: instance, kind (null: unknown), pattern, and plain, if some are.
    """
    if "plain" not in found.columns:
        found = found.withColumn("plain", F.lit(False))
    edges = cut(found.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.min("plain").alias("plain")))
    learned, told = None, 0
    while True:
        known, good = trusted(edges, learned, support, confidence, plain)
        # an instance takes the kind of its most trusted pattern
        gained = known.where("kind is null").join(good, "pattern").where("_plain or not plain").groupBy("instance").agg(F.max(F.struct("_trust", "_kind")).alias("_top"))
        gained = gained.select("instance", F.col("_top._kind").alias("kind"))
        learned = cut(gained if learned is None else learned.unionByName(gained))
        now = learned.count()
        if now == told:
            return learned
        told = now


def _bits(patterns: DataFrame) -> bytes:
    """A bit for each of 2^24 prefixes of patterns: a table of fixed size."""
    prefix = F.shiftrightunsigned("pattern", 64 - PREFIX_BITS)
    bits = np.zeros(1 << PREFIX_BITS - 3, np.uint8)
    for r in patterns.select(F.shiftright(prefix, 3).alias("at"), F.call_function("shiftleft", F.lit(1), (prefix % 8).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["at"]] |= r["bit"]
    return bits.tobytes()


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, base and added spans (kind:start:end, comma-joined; base by kind, added by start) of each row."""
    ship_package(docs.sparkSession)
    texts = keyed(docs)
    rows = materialise(mentions(texts), "pii-mentions")
    each = rows.select("key", "key2", F.explode("mentions").alias("m")).select("key", "key2", "m.*")
    graph = each.select("instance", "kind", F.explode("patterns").alias("pattern"), F.lit(False).alias("plain"))
    plain, seen = None, None
    while True:
        votes = graph if plain is None else graph.unionByName(plain.select("instance", F.lit(None).cast("string").alias("kind"), "pattern", F.lit(True).alias("plain")))
        learned = bootstrap(votes, **limits)
        edges = votes.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.min("plain").alias("plain"))
        good = cut(trusted(edges, learned, **limits)[1].select("pattern", "_kind", "_plain"))
        new = good.select("pattern") if seen is None else good.select("pattern").join(seen, "pattern", "left_anti")
        if new.isEmpty():
            break
        new = cut(new)
        # what the table of bits lets through by chance goes by the join
        more = materialise(plain_mentions(texts, _bits(new)).join(new, "pattern").select("key", "key2", "start", "end", "instance", "pattern"), "pii-plain")
        plain = more if plain is None else plain.unionByName(more)
        seen = new if seen is None else seen.unionByName(new)
    hits = each.where("kind is null").select("key", "key2", "start", "end", "instance").join(learned, "instance").select("key", "key2", "start", "end", "kind")
    if plain is not None:
        held = plain.join(good.where("_plain"), "pattern").join(learned, "instance").where("kind = _kind")
        hits = hits.unionByName(held.select("key", "key2", "start", "end", "kind"))
    one = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    # a span within another one goes
    before = Window.partitionBy("key", "key2").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.distinct().withColumn("_reach", F.max("end").over(before)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    added = hits.groupBy("key", "key2").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("span")))).alias("_a"))
    added = added.select("key", "key2", F.concat_ws(",", F.transform("_a", lambda x: x["span"])).alias("added"))
    return rows.select("doc_id", "key", "key2", "base").join(added, ["key", "key2"], "left").select("doc_id", "base", F.coalesce("added", F.lit("")).alias("added"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context of every document."""
    found = find(read_table(spark, sf_dir, "documents"))
    count = [F.regexp_count("base", F.lit(f"(^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "added")))
    n_added = F.when(F.col("added") == "", 0).otherwise(F.regexp_count("added", F.lit(",")) + 1).cast("long")
    return found.select("doc_id", *count, F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), both.alias("spans"), n_added.alias("n_context"))
