"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units (after a number) turn into
typed slots, other words into hashes of their lower-cased bytes, and punctuation goes. Windows of WORDS template
words of documents and benchmark items are joined by hash. Windows of a document that lie along one item at one offset
are a placement. In it a value of the item's slots is bound to the value it faces in the document in at least half of
its places, if there is one, and no two of them to the same; windows with another value there don't count, unless it is
the item's own. So a question
with new numbers or names is found, and a chance likeness of slots is not. Items' windows are there a second
time with names as plain words, for documents in capitals or without any. A capitalised word that begins a sentence or
line may be a name or not, so windows with one are there both ways, of items and of documents. A document leaks an item if
windows that count cover the given share of the item's windows, or those of one placement cover RUN
consecutive words.

A bit for each of 2^24 hash prefixes of the benchmark's windows, a table of fixed size, is what the documents are
sifted with; the join itself is on the full hash, dealt out by it.

Beside these, windows of the words as they are, without slots, are joined in the same way, so that items of mostly
numbers or names are found word for word. The coverage is the largest of the shares of the windows with slots, of these
and those with plain names, and of all.

Cases: null and empty texts have no windows. An item of fewer than WORDS words is one window of its own length; one of
fewer than LEAST is matched word for word only. Windows with slots and fewer than half literal words are left out.
Repeated items or rows are matched each;
rows with equal doc_id and text are one. Null ids of items and documents stay null in the result. Empty tables give
an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.arrowtext import lowered, mix, release, slices, tokens, utf8, windows
from strataflow.session import cut, read_table, ship_package

WORDS, LEAST, COVERAGE, RUN = 8, 5, 0.3, 13
PREFIX_BITS = 24

#: Units that a number may carry.
UNITS = (
    "mm cm m km in ft yd mi miles mile inch inches feet foot metre metres meter meters kilometre kilometres kilometer kilometers "
    "g kg mg lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml l cl litre litres liter liters gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent pct degree degrees celsius fahrenheit kelvin "
    "mph kph hz khz mhz ghz w kw mw v a kb mb gb tb bytes bits j kj cal kcal pa kpa"
).split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x4E554D4245520001, 0x4E414D4500000001, 0x554E495400000001))


def _hashes(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.large_string())
    return tokens(*utf8(column))[2]


def template(data: np.ndarray, offs: np.ndarray, low: np.ndarray | None = None, names: bool = True, exact: bool = False, initial: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, hashes (slots replaced), slot kinds (0 none, 1 number, 2 name, 3 unit) of all words, and n + 1 offsets of documents' words. exact: no slots; initial: names also where sentences begin."""
    starts, lens, h, kind, docs = tokens(data, offs, low)
    word = kind == 1
    if not word.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, np.zeros(len(offs), np.int64)
    if exact:
        return starts[word], lens[word], h[word], np.zeros(int(word.sum()), np.int64), np.concatenate(([0], np.cumsum(word)))[docs]
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    digit = (first >= 48) & (first <= 57)
    title = (first >= 65) & (first <= 90) & (lens >= 2) & (((second >= 97) & (second <= 122)) | (second >= 128))
    # inside a sentence: after a word or a comma of the same document, on the same line
    inner = np.zeros(len(starts), bool)
    before_end = starts[:-1] + lens[:-1]
    last = data[before_end - 1]
    inner[1:] = (kind[:-1] == 1) | (last == 44)
    inner[docs[:-1][docs[:-1] < len(starts)]] = False
    lines = np.cumsum(data == 10)
    inner[1:] &= lines[starts[1:]] == lines[before_end - 1]
    slot = np.where(digit, 1, np.where(title & (inner | initial) & names, 2, 0))
    numbered = np.zeros(len(starts), bool)
    numbered[1:] = slot[:-1] == 1
    numbered[docs[:-1][docs[:-1] < len(starts)]] = False
    slot[numbered & (slot == 0) & np.isin(h, np.unique(_hashes(list(UNITS))))] = 3
    h = np.choose(slot, [h, np.full_like(h, NUMBER), np.full_like(h, NAME), np.full_like(h, UNIT)])
    place = np.concatenate(([0], np.cumsum(word)))
    return starts[word], lens[word], h[word], slot[word], place[docs]


def _window_rows(column: pa.Array, lengths: list[int], wanted: np.ndarray | None, whole: int, names: bool = True, exact: bool = False, initial: bool = False) -> dict[str, list]:
    """Windows of some texts: row, position, hash, slots. wanted: bits of hash prefixes; whole: texts of fewer words are one window."""
    data, offs = utf8(column)
    starts, lens, h, slot, docs = template(data, offs, lowered(column, data, offs), names, exact, initial)
    sizes = np.diff(docs)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    literal = np.concatenate(([0], np.cumsum(slot == 0)))
    out: dict[str, list] = {"row": [], "pos": [], "hash": [], "slots": [], "places": [], "n": []}
    for w in lengths:
        if w < LEAST and not exact:
            continue
        hw = mix(windows(h, w) + np.uint64(w))
        at = np.arange(len(hw))
        ok = row_of[at] == row_of[at + w - 1] if len(hw) else np.zeros(0, bool)
        ok &= 2 * (literal[at + w] - literal[at]) >= w
        if whole:
            ok &= (sizes[row_of[at]] == w) | (w == whole)
        if wanted is not None:
            prefix = hw >> np.uint64(64 - PREFIX_BITS)
            ok &= (wanted[prefix >> np.uint64(3)] >> (prefix & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = at[ok]
        if w < LEAST:  # once a text
            at = at[np.sort(np.unique(np.stack((row_of[at].astype(np.uint64), hw[at])), axis=1, return_index=True)[1])]
        for i in at.tolist():
            places = [j for j in range(i, i + w) if slot[j]] if slot[i : i + w].any() else []
            values = [data[starts[j] : starts[j] + lens[j]].tobytes().decode("utf-8", "replace").lower() for j in places]
            out["slots"].append(values)
            out["places"].append([j - int(docs[row_of[i]]) for j in places])
        out["row"] += row_of[at].tolist()
        out["pos"] += (at - docs[row_of[at]]).tolist()
        out["hash"] += hw[at].view(np.int64).tolist()
        out["n"] += [w] * len(at)
    return out


def row_key(key: str) -> Column:
    """128 bits that tell rows apart."""
    return F.concat_ws("-", F.hex(F.xxhash64(key, "text")), F.hex(F.xxhash64("text", key)))


def _windows(table: DataFrame, key: str, lengths: list[int], wanted: object = None, whole: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                w = _window_rows(part.column("text"), lengths, bits, whole)
                w["variant"] = [0] * len(w["row"])
                held = set(zip(w["row"], w["pos"], w["hash"], strict=True))
                # a sentence's first word may be a name; an item's names also stand for themselves, as texts in one case have none; and all words of all texts
                for variant, how in [(0, {"initial": True})] + ([(1, {"names": False})] if whole else []) + [(2, {"exact": True})]:
                    more = _window_rows(part.column("text"), lengths, bits, whole, **how)
                    new = [i for i, x in enumerate(zip(more["row"], more["pos"], more["hash"], strict=True)) if x not in held]
                    held.update((more["row"][i], more["pos"][i], more["hash"][i]) for i in new)
                    for c in more:
                        w[c] += [more[c][i] for i in new]
                    w["variant"] += [variant] * len(new)
                rows = pa.array(w["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key).take(rows), part.column("key").take(rows), pa.array(w["pos"], pa.int32()), pa.array(w["n"], pa.int32()), pa.array(w["hash"], pa.int64()), pa.array(w["slots"], pa.list_(pa.string())), pa.array(w["places"], pa.list_(pa.int32())), pa.array(w["variant"], pa.int32())], names=[key, "key", "pos", "n", "hash", "slots", "places", "variant"])
        release()

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, row_key(key).alias("key"), "text").mapInArrow(run, f"{key} {kind}, key string, pos int, n int, hash long, slots array<string>, places array<int>, variant int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """doc_id, item_id, key (of the row, as row_key), n_windows matched, coverage, changed (some slot differs)."""
    spark = docs.sparkSession
    ship_package(spark)
    items = cut(_windows(benchmark.select("item_id", "text").distinct(), "item_id", list(range(1, words + 1)), whole=words))
    words_of = items.select("n").distinct().collect()  # a few lengths
    prefix = F.shiftrightunsigned("hash", 64 - PREFIX_BITS)
    bits = np.zeros(1 << PREFIX_BITS - 3, np.uint8)
    for r in items.select(F.shiftright(prefix, 3).alias("at"), F.call_function("shiftleft", F.lit(1), (prefix % 8).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["at"]] |= r["bit"]
    if not words_of:
        lengths = [words]
    else:
        lengths = sorted(r["n"] for r in words_of)
    found = _windows(docs, "doc_id", lengths, spark.sparkContext.broadcast(bits.tobytes()))
    upto = [F.when(F.col("variant") <= v, F.col("pos")) for v in range(3)]
    total = items.groupBy("item_id", "key").agg(*(F.count_distinct(p).alias(f"total{v}") for v, p in enumerate(upto)))
    left = items.select("item_id", F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), "n", "hash", F.col("slots").alias("item_slots"), "places", F.col("variant").alias("item_variant"))
    met = found.drop("variant", "places").join(left, ["hash", "n"]).where(F.size("slots") == F.size("item_slots"))
    met = cut(met.select("doc_id", "key", "item_id", "item_key", "item_pos", "item_variant", "n", (F.col("pos") - F.col("item_pos")).alias("offset"), F.arrays_zip("item_slots", "slots", "places").alias("pairs")))
    placement = ["key", "item_key", "offset"]
    faced = met.select(*placement, F.explode("pairs").alias("p")).groupBy(*placement, F.col("p.item_slots").alias("old"), F.col("p.slots").alias("new")).agg(F.count_distinct("p.places").alias("k"))
    most = faced.groupBy(*placement, "old").agg(F.max(F.struct("k", F.col("new").eqNullSafe(F.col("old")).alias("same"), "new")).alias("top"), F.sum("k").alias("all"))
    # one-to-one: of several values that face one value the one with most places is bound, or the one that is the same
    single = most.where(2 * F.col("top.k") >= F.col("all")).groupBy(*placement, F.col("top.new").alias("new")).agg(F.max(F.struct("top.same", "top.k", "old")).alias("one"))
    bound = single.groupBy(*placement).agg(F.map_from_entries(F.collect_list(F.struct(F.col("one.old"), "new"))).alias("bound"))
    agrees = F.forall("pairs", lambda p: (p["slots"] == p["item_slots"]) | F.coalesce(F.try_element_at("bound", p["item_slots"]) == p["slots"], F.lit(False)))
    counted = met.join(bound, placement, "left").where(agrees).withColumn("changed", F.exists("pairs", lambda p: p["slots"] != p["item_slots"]))
    # consecutive windows of one placement that make up a run of words
    need = max(1, run - words + 1)
    at = counted.where(F.col("n") == words).groupBy("doc_id", *placement).agg(F.array_sort(F.collect_set("item_pos")).alias("at"))
    longest = F.exists(F.sequence(F.lit(0), F.size("at") - need), lambda i: F.get("at", i + need - 1) - F.get("at", i) == need - 1)
    runs = at.where(F.size("at") >= need).where(longest).select("key", "item_key", F.lit(True).alias("run")).distinct()
    hit = counted.groupBy("doc_id", "key", "item_id", "item_key").agg(*(F.count_distinct(F.when(F.col("item_variant") <= v, F.col("item_pos"))).alias(f"hit{v}") for v in range(3)), F.coalesce(F.max("changed"), F.lit(False)).alias("changed"))
    parts = [F.coalesce(F.try_divide(f"hit{v}", f"total{v}"), F.lit(0.0)) for v in range(3)]
    share = hit.join(total.select(F.col("key").alias("item_key"), *(f"total{v}" for v in range(3))), "item_key").withColumn("coverage", F.greatest(*parts)).withColumnRenamed("hit2", "n_windows")
    share = share.join(runs, ["key", "item_key"], "left")
    return share.where((F.col("coverage") >= coverage) | F.col("run")).select("doc_id", "item_id", "key", "n_windows", "coverage", "changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that leak no item."""
    leaks = find_leaks(docs, benchmark, **limits).select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", row_key("doc_id")).join(leaks, "_key", "left_anti").drop("_key")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, changed for each document that leaks an item."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")
