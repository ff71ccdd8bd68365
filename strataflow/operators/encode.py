"""Bitplanes as tables: logical bits, group words, plane statistics, and packed payloads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import bitplane
from strataflow.functions.errors import level_bound
from strataflow.functions.grid import exponent

WORD = 32


def with_exponent(coefficients: DataFrame, by: list[str]) -> DataFrame:
    """With max_abs and exp of the group that an element belongs to."""
    top = coefficients.groupBy(*by).agg(F.max(F.abs("value")).alias("max_abs"))
    return coefficients.join(top.withColumn("exp", exponent(F.col("max_abs"))), by)


def level_bounds(coefficients: DataFrame, by: list[str], negabinary: bool = False) -> DataFrame:
    """Largest magnitude, exponent, bound and count of each group."""
    top = coefficients.groupBy(*by).agg(F.max(F.abs("value")).alias("max_abs"), F.count("*").alias("n"))
    return top.select(*by, "max_abs", exponent(F.col("max_abs")).alias("exp"), level_bound(F.col("max_abs"), negabinary).alias("bound"), "n")


def encoded(df: DataFrame, planes: int, form: str = "perbit") -> DataFrame:
    """With code and sign. df: value, exp."""
    bitplane.check_planes(planes, form)
    code, sign = bitplane.encode(F.col("value"), F.col("exp"), planes, form)
    return df.withColumns({"code": code, "sign": sign})


def plane_bits(coded: DataFrame, keys: list[str], planes: int) -> DataFrame:
    """A row for each element and plane: keys, plane, bit."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(planes - 1)), lambda p: F.struct(p.alias("plane"), bitplane.bit(F.col("code"), p, planes).alias("bit")))
    return coded.select(*keys, F.explode(bits).alias("b")).select(*keys, "b.plane", "b.bit")


def ones_by_plane(coded: DataFrame, by: list[str], planes: int) -> DataFrame:
    """How many ones each plane holds, counted in one pass without a row for each bit."""
    counts = coded.groupBy(*by).agg(*(F.sum(bitplane.bit(F.col("code"), p, planes)).alias(f"p{p}") for p in range(planes)))
    return counts.select(*by, F.posexplode(F.array(*(f"p{p}" for p in range(planes))))).withColumnsRenamed({"pos": "plane", "col": "ones"})


def perbit_sizes(coded: DataFrame, by: list[str], planes: int) -> DataFrame:
    """Bits and bytes of each plane of the per-bit form: an element's bit, and its sign in the plane of its first one."""
    first = bitplane.first_plane(F.col("code"), planes)
    counts = coded.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(first == p).alias(f"p{p}") for p in range(planes)))
    rows = counts.select(*by, "n", F.posexplode(F.array(*(f"p{p}" for p in range(planes)))))
    return rows.select(*by, F.col("pos").alias("plane"), (F.col("n") + F.col("col")).alias("bits"), (F.ceil((F.col("n") + F.col("col")) / 64) * 8).cast("bigint").alias("bytes"))


def group_words(coded: DataFrame, by: list[str], planes: int, word: int = WORD) -> DataFrame:
    """A word for each group of `word` elements and plane: by, grp, plane, word_bits. coded: pos among the rest."""
    grp = F.floor(F.col("pos") / word).cast("bigint")
    at = (F.col("pos") % word).cast("int")
    words = coded.groupBy(*by, grp.alias("grp")).agg(*(F.bit_or(F.call_function("shiftleft", bitplane.bit(F.col("code"), p, planes).cast("bigint"), at)).alias(f"p{p}") for p in range(planes)))
    return words.select(*by, "grp", F.posexplode(F.array(*(f"p{p}" for p in range(planes))))).withColumnsRenamed({"pos": "plane", "col": "word_bits"})


def group_starts(coded: DataFrame, by: list[str], planes: int, word: int = WORD) -> DataFrame:
    """The first plane with a one in each group (planes if none), and the group's signs as a word."""
    grp = F.floor(F.col("pos") / word).cast("bigint")
    at = (F.col("pos") % word).cast("int")
    sign = F.call_function("shiftleft", F.col("sign").cast("int").cast("bigint"), at)
    return coded.groupBy(*by, grp.alias("grp")).agg(F.min(bitplane.first_plane(F.col("code"), planes)).alias("start"), F.bit_or(sign).alias("signs"))


def decoded(coded: DataFrame, planes: int, taken: int, form: str = "perbit") -> DataFrame:
    """With decoded, what the first `taken` planes give."""
    return coded.withColumn("decoded", bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), planes, taken, form))


def squared_errors(coded: DataFrame, by: list[str], planes: int, form: str = "perbit") -> DataFrame:
    """Sum of squared errors after 0..planes planes, in one pass."""
    diff = [F.col("value") - bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), planes, b, form) for b in range(planes + 1)]
    sums = coded.groupBy(*by).agg(*(F.sum(d * d).alias(f"b{b}") for b, d in enumerate(diff)))
    return sums.select(*by, F.posexplode(F.array(*(f"b{b}" for b in range(planes + 1))))).withColumnsRenamed({"pos": "taken", "col": "squared_error"})


def largest_errors(coded: DataFrame, by: list[str], planes: int, form: str = "perbit") -> DataFrame:
    """Largest error after 0..planes planes, in one pass."""
    diff = [F.abs(F.col("value") - bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), planes, b, form)) for b in range(planes + 1)]
    tops = coded.groupBy(*by).agg(*(F.max(d).alias(f"b{b}") for b, d in enumerate(diff)))
    return tops.select(*by, F.posexplode(F.array(*(f"b{b}" for b in range(planes + 1))))).withColumnsRenamed({"pos": "taken", "col": "max_error"})


# ---- packed payloads ----


def _squeeze(raw: bytes, level: int = 3) -> bytes:
    return len(raw).to_bytes(8, "little") + zstandard.ZstdCompressor(level=level).compress(raw)


def _expand(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body[8:], max_output_size=int.from_bytes(body[:8], "little") or 1)


def kept_compressed(ratios: list[float], policy: str, latter: int = 26) -> list[bool]:
    """Which planes of a level stay compressed.

    adaptive: up to the first plane after plane 0 that shrinks by less than a twentieth, that one included, and again
    from plane `latter` on.
    """
    if policy == "none":
        return [False] * len(ratios)
    if policy == "all":
        return [True] * len(ratios)
    stop = next((p for p, r in enumerate(ratios) if p and r < 1.05), len(ratios))
    return [p <= stop or p >= latter for p in range(len(ratios))]


def pack_planes(code: np.ndarray, sign: np.ndarray, planes: int, signed: bool) -> list[bytes]:
    """Each plane's bits, eight to a byte; with signs, plane p then holds the signs of elements whose first one is there."""
    first = np.full(len(code), planes)
    out = []
    for p in range(planes):
        bits = (code >> (planes - 1 - p)) & 1
        body = np.packbits(bits.astype(np.uint8)).tobytes()
        if signed:
            new = (first == planes) & (bits == 1)
            first[new] = p
            body += np.packbits(sign[new].astype(np.uint8)).tobytes()
        out.append(body)
    return out


def unpack_planes(bodies: list[bytes], n: int, planes: int, signed: bool, start: int = 0, code: np.ndarray | None = None, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and signs from planes start, start + 1, ..., on top of those that earlier planes gave."""
    code = np.zeros(n, np.int64) if code is None else code.astype(np.int64)
    sign = np.zeros(n, bool) if sign is None else sign.copy()
    size = -(-n // 8)
    for p, body in enumerate(bodies, start):
        bits = np.unpackbits(np.frombuffer(body, np.uint8, size), count=n).astype(np.int64)
        if signed:
            new = (code == 0) & (bits == 1)
            sign[new] = np.unpackbits(np.frombuffer(body, np.uint8, -1, size), count=int(new.sum())).astype(bool)
        code |= bits << (planes - 1 - p)
    return code, sign


def pack_groups(code: np.ndarray, sign: np.ndarray, planes: int, word: int = WORD) -> list[bytes]:
    """Each plane by groups of `word` elements: which groups begin in it, their sign words, and words of groups begun.

    Planes before a group's first one take a bit, not a word. A table of the starting planes is spread over the planes:
    in each, groups not yet begun have a bit that says whether they begin.
    """
    n = -(-len(code) // word)
    full = np.zeros((n, word), np.int64)
    full.ravel()[: len(code)] = code
    signs = np.zeros((n, word), bool)
    signs.ravel()[: len(code)] = sign & (code > 0)
    begun, out = np.zeros(n, bool), []
    for p in range(planes):
        bits = (full >> (planes - 1 - p) & 1).astype(bool)
        begin = ~begun & bits.any(axis=1)
        body = np.packbits(begin[~begun]).tobytes() + np.packbits(signs[begin], axis=1).tobytes()
        begun |= begin
        out.append(body + np.packbits(bits[begun], axis=1).tobytes())
    return out


def unpack_groups(bodies: list[bytes], n: int, planes: int, start: int = 0, code: np.ndarray | None = None, sign: np.ndarray | None = None, word: int = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Codes and signs from planes start, start + 1, ..., on top of those that earlier planes gave.

    All of a group's signs come when it begins; those of elements without a one so far mean nothing yet.
    """
    groups = -(-n // word)
    full, signs = np.zeros((groups, word), np.int64), np.zeros((groups, word), bool)
    if code is not None:
        full.ravel()[:n], signs.ravel()[:n] = code, sign
    begun, wide = (full != 0).any(axis=1), -(-word // 8)
    for p, body in enumerate(bodies, start):
        rest = np.flatnonzero(~begun)
        told = np.unpackbits(np.frombuffer(body, np.uint8, -(-len(rest) // 8)), count=len(rest)).astype(bool)
        at, begin = -(-len(rest) // 8), rest[told]
        signs[begin] = np.unpackbits(np.frombuffer(body, np.uint8, len(begin) * wide, at).reshape(len(begin), wide), axis=1, count=word).astype(bool)
        at += len(begin) * wide
        begun[begin] = True
        bits = np.unpackbits(np.frombuffer(body, np.uint8, int(begun.sum()) * wide, at).reshape(-1, wide), axis=1, count=word)
        full[begun] |= bits.astype(np.int64) << (planes - 1 - p)
    return full.ravel()[:n], signs.ravel()[:n]


FRAGMENTS = "block long, var string, level int, plane int, payload binary, size long, raw_size long, compressed boolean, n long"


def fragments(coded: DataFrame, planes: int, form: str = "perbit", policy: str = "adaptive", latter: int = 26) -> DataFrame:
    """Packed planes of each (block, var, level), a unit that fits in memory. coded: pos, code, sign among the rest."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        code, sign = table.column("code").to_numpy()[order], table.column("sign").to_numpy(zero_copy_only=False)[order]
        raw = pack_groups(code, sign, planes) if form == "grouped" else pack_planes(code, sign, planes, "negabinary" not in form)
        small = [_squeeze(b) for b in raw]
        keep = kept_compressed([len(a) / len(b) for a, b in zip(raw, small, strict=True)], policy, latter)
        bodies = [s if k else r for r, s, k in zip(raw, small, keep, strict=True)]
        n, block, var, level = len(raw), key[0].as_py(), key[1].as_py(), key[2].as_py()
        return pa.table(
            {"block": pa.array([block] * n, pa.int64()), "var": pa.array([var] * n, pa.string()), "level": pa.array([level] * n, pa.int32()), "plane": pa.array(range(n), pa.int32()), "payload": pa.array(bodies, pa.binary())}
            | {"size": pa.array([len(b) for b in bodies], pa.int64()), "raw_size": pa.array([len(b) for b in raw], pa.int64()), "compressed": pa.array(keep), "n": pa.array([len(order)] * n, pa.int64())}
        )

    return coded.select("block", "var", "level", "pos", "code", "sign").groupBy("block", "var", "level").applyInArrow(run, FRAGMENTS)


CODES = "block long, var string, level int, pos long, code long, sign boolean, taken int"


def _unpacked(key: tuple[pa.Scalar, ...], table: pa.Table, held: pa.Table | None, planes: int, form: str) -> pa.Table:
    had = held.num_rows > 0 if held is not None else False
    if table.num_rows == 0:
        return held.select(["block", "var", "level", "pos", "code", "sign", "taken"])
    table = table.sort_by("plane")
    held = held.sort_by("pos") if had else None
    start = held.column("taken")[0].as_py() if had else 0
    if table.column("plane").to_pylist() != list(range(start, start + table.num_rows)):
        raise ValueError("planes are missing")
    n = table.column("n")[0].as_py()
    bodies = [_expand(b) if c else b for b, c in zip(table.column("payload").to_pylist(), table.column("compressed").to_pylist(), strict=True)]
    before = (held.column("code").to_numpy(), held.column("sign").to_numpy(zero_copy_only=False)) if had else (None, None)
    code, sign = unpack_groups(bodies, n, planes, start, *before) if form == "grouped" else unpack_planes(bodies, n, planes, "negabinary" not in form, start, *before)
    fill = lambda v, t: pa.array([v] * n, t)
    return pa.table({"block": fill(key[0].as_py(), pa.int64()), "var": fill(key[1].as_py(), pa.string()), "level": fill(key[2].as_py(), pa.int32()), "pos": np.arange(n), "code": code, "sign": sign, "taken": fill(start + len(bodies), pa.int32())})


def unpack(frags: DataFrame, planes: int, form: str = "perbit", held: DataFrame | None = None) -> DataFrame:
    """(block, var, level, pos, code, sign, taken) from fragments: planes 0, 1, ... of their level, or those after the held ones."""
    by = ["block", "var", "level"]
    new = frags.select(*by, "plane", "payload", "compressed", "n").groupBy(*by)
    if held is None:
        return new.applyInArrow(lambda key, t: _unpacked(key, t, None, planes, form), CODES)
    return new.cogroup(held.groupBy(*by)).applyInArrow(lambda key, t, h: _unpacked(key, t, h, planes, form), CODES)


def dense(df: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    """With pos, the place within a group by an order."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("bigint"))
