"""Quality classifier by importance resampling.

Documents are bags of hashed one- and two-token grams. Two multinomial models over the hash buckets, one of target
text and one of all raw text, give each document the log of its likelihood ratio; with a Gumbel variate added, the k
largest keys are a sample without replacement in proportion to the ratios. Taking the top k needs no sort: counts of the
keys' leading 16 bits tell in which of these the k-th largest key lies, counts of the next 16 bits of those keys go on
from there, and the sample is what reaches the key so found. k is a parameter; where none is given, it is the number of
documents that reach a cut between labelled good and bad ones.

Cases: null or empty text has ratio 0 (weight 1), so only its Gumbel variate counts. Rows with equal doc_id and text
have equal keys and are kept or dropped together, so repeats of the k-th may exceed k; other ties go by a hash of id and
text. Labels that disagree count as bad. Without labels of either kind
nothing can be told apart, and every document stays, whatever k. An empty table gives an empty result. Further columns are
carried along; `log_weight` and `gumbel_key` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.arrowtext import mix, per_document, release, slices, tokens, utf8, windows
from strataflow.session import materialise, read_table, ship_package

BUCKETS = 16_384
#: Labelled rows that models and cut are fitted on, at most, for each of good and bad.
LABELLED = 20_000
SEED = 17
#: Occurrences of a gram, in target text and as expected there, that count as seen beforehand; draws rare grams to ratio 1.
PRIOR = 8.0
#: Grams from which a longer text's log ratio counts by its mean, or None: grams of a text aren't independent, and with few
#: labels a slight bias against one language sums up to sink its long texts. Of a thousand documents with 399 labels at most 5
#: of 58 bad ones are kept with this and 6 without; of 51,282 with 20,598 labels, 248 of 2,766 with this and 208 without.
EFFECTIVE = 100
#: The columns that are made here.
ADDED = ("log_weight", "gumbel_key", "_order", "_tie")
#: A share of good documents lost weighs as much as this many times the share of bad ones kept.
GOOD = 4.0


def _grams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams, and the n + 1 offsets of the documents' grams."""
    data, offs = utf8(column)
    _, _, h, _, docs = tokens(data, offs)
    pairs = windows(h, 2)
    inner = np.ones(len(pairs), bool)
    cuts = docs[1:-1]
    inner[cuts[(cuts > 0) & (cuts <= len(pairs))] - 1] = False
    both = np.zeros((len(h), 2), np.int64)
    both[:, 0] = h % np.uint64(buckets)
    both[:, 1] = -1
    if len(pairs):
        both[:-1, 1][inner] = (pairs % np.uint64(buckets)).astype(np.int64)[inner]
    flat = both.ravel()
    keep = flat >= 0
    at = np.concatenate(([0], np.cumsum(keep)))
    return flat[keep], at[docs * 2]


def labelled_ids(labels: DataFrame, limit: int = LABELLED, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Ids of good and of bad documents, at most `limit` of each, by hash order. Good: quality 1 and not toxic."""
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = (F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)
    bad = F.col("q") == 0
    order = F.xxhash64(F.lit(seed), "doc_id")
    pick = lambda which: [r[0] for r in by_id.where(which).orderBy(order, "doc_id").limit(limit).select("doc_id").collect()]
    return pick(good), pick(bad)


def ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + PRIOR) / (expected + PRIOR))


def fit(docs: DataFrame, good: list[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts of each bucket. Raw counts cover all documents."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(np.unique(np.array(good, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            is_good = np.isin(np.array(batch.column("doc_id").fill_null(-1).cast(pa.int64())), ids.value)
            is_good &= np.array(batch.column("doc_id").is_valid())
            for a, b in slices(batch.column("text")):
                grams, offs = _grams(batch.column("text").slice(a, b - a), buckets)
                raw += np.bincount(grams, minlength=buckets)
                flag = np.repeat(is_good[a:b], np.diff(offs))
                target += np.bincount(grams[flag], minlength=buckets)
        release()
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": pa.array(raw[used]), "target": pa.array(target[used])})

    counted = docs.select("doc_id", "text").mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():  # one row for each bucket at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return raw, target


def gumbel(ids: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A Gumbel variate fixed by seed, id and length of text."""
    u = mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) ^ lengths.astype(np.uint64))
    return -np.log(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def ordered(keys: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (keys + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & np.int64(2**63 - 1))


def _temper(sizes: np.ndarray, effective: int | None) -> np.ndarray:
    return np.ones(len(sizes)) if effective is None else np.minimum(1.0, effective / np.maximum(1, sizes))


def _without(counts: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> float:
    """The log weight of a text of the target by the model of all others."""
    raw, target = counts
    used, n = np.unique(grams, return_counts=True)
    expected = raw[used] * ((target.sum() - len(grams)) / max(raw.sum(), 1.0))
    return float((n * np.log((target[used] - n + PRIOR) / (expected + PRIOR))).sum())


def score(docs: DataFrame, counts: tuple[np.ndarray, np.ndarray], seed: int = SEED, effective: int | None = EFFECTIVE) -> DataFrame:
    """docs with log_weight, gumbel_key, _order (longs in the order of the keys) and _tie.

    If docs has a column _own, texts where it is true count as if the target model had not seen them.
    """
    docs = docs.drop(*ADDED).withColumn("_tie", F.xxhash64("doc_id", "text"))
    model = docs.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType()), T.StructField("_order", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = ratio(*model.value)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                grams, offs = _grams(part.column("text"), len(logs))
                weight = per_document(logs[grams], offs)
                for i in np.flatnonzero(np.array(part.column("_own"))).tolist() if "_own" in part.schema.names else ():
                    weight[i] = _without(model.value, grams[offs[i] : offs[i + 1]])
                weight *= _temper(np.diff(offs), effective)
                ids = np.array(part.column("doc_id").cast(pa.int64()).fill_null(-1))
                key = weight + gumbel(ids, np.diff(offs), seed)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight), pa.array(key), pa.array(ordered(key))], names=[*part.schema.names, "log_weight", "gumbel_key", "_order"])
        release()

    return docs.mapInArrow(run, schema)


def cut_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The key that best separates good from bad: the middle of the widest of the best gaps."""
    if not len(good) or not len(bad):
        return -np.inf
    keys = np.concatenate((good, bad))
    order = np.argsort(keys, kind="stable")
    sign = np.concatenate((np.full(len(good), -GOOD / len(good)), np.full(len(bad), 1 / len(bad))))[order]
    keys = keys[order]
    gain = np.concatenate(([0], np.cumsum(sign)))  # with a cut before each key
    gain[1:-1][keys[1:] == keys[:-1]] = -np.inf
    lower, upper = np.concatenate(([keys[0] - 1], keys)), np.concatenate((keys, [keys[-1] + 1]))
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[np.argmax(upper[best] - lower[best])]
    return float((lower[at] + upper[at]) / 2)


def kth_largest(keys: DataFrame, columns: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th largest of rows of long columns, the first foremost; None if there are no k rows.

    Each round counts 16 bits of the rows that agree with what is known so far: 65,536 rows at most come to the driver.
    """
    found: list[int] = []
    for c in columns:
        value, same = 0, [F.col(x) == v for x, v in zip(columns, found, strict=False)]
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-(2**63))), shift)
            rows = keys
            for condition in same:
                rows = rows.where(condition)
            if shift < 48:
                rows = rows.where(F.shiftrightunsigned(digit, 16) == value)
            counts = sorted(rows.groupBy(digit.bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().collect(), reverse=True)
            for digit_value, n in counts:
                if k <= n:
                    value = value << 16 | digit_value
                    break
                k -= n
            else:
                return None
        found.append(value - 2**63)
    return tuple(found)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, limit: int = LABELLED, seed: int = SEED, effective: int | None = EFFECTIVE) -> DataFrame:
    """The k documents that stay, with log_weight and gumbel_key: a Gumbel top-k sample by importance."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(*ADDED)
    good, bad = labelled_ids(labels, limit, seed)
    if not good or not bad:
        return docs.withColumns({"log_weight": F.lit(0.0), "gumbel_key": F.lit(0.0)})
    counts = fit(docs, good, buckets)
    keys = materialise(score(docs.select("doc_id", "text"), counts, seed, effective).select("gumbel_key", "_order", "_tie"), "importance-keys")
    if k is None:
        # the cut is set on labelled documents, each good one as the target model of the others sees it
        known = spark.createDataFrame([(i, True) for i in good] + [(i, False) for i in bad], "doc_id long, _own boolean")
        fitted = score(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), counts, seed, effective)
        # one row for each labelled id, of which there are 2 * limit at most
        fitted = fitted.groupBy("doc_id").agg(F.first("_own").alias("good"), F.min("gumbel_key").alias("key")).toPandas()
        k = keys.where(F.col("gumbel_key") >= F.lit(cut_between(fitted.key[fitted.good].to_numpy(), fitted.key[~fitted.good].to_numpy()))).count()
    scored = score(docs, counts, seed, effective)
    if k <= 0:
        return scored.limit(0).drop("_order", "_tie")
    least = kth_largest(keys, ["_order", "_tie"], k)
    if least is not None:
        order, tie = least
        scored = scored.where((F.col("_order") > order) | (F.col("_order") == order) & (F.col("_tie") >= tie))
    return scored.drop("_order", "_tie")


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept: doc_id, log_weight, gumbel_key, kept (true)."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return resample(docs.select("doc_id", "text"), labels).select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept"))
