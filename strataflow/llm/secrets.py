"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds what each blob gave under each
version of the rules; only blobs that it lacks for the present version are scanned, each once, however many paths hold
it. Findings join back to all paths by blob. A kept ledger is a table partitioned by rule version, to which each run
adds what it scanned; with one, blobs are first compared by address alone, and only the texts of unseen ones move.

Spans come from the texts between matches: a rule's matches and the pieces that splitting by the rule leaves alternate,
so running sums of their lengths are the places, in code points. The sums run over CHUNK matches at a time, and then over
the chunks' totals, so that a text of very many matches takes no time in the square of their number.

Cases: null content counts as empty, and has the empty blob's address. A match that fails its rule's length is dropped
and not retried. Repeated rows give repeated results; a null path keeps its row. An empty table, or empty ledger,
gives an empty result, or a full scan. Columns other than the path are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.session import materialise, read_table, shared_path

#: Matches whose places are summed up at a time.
CHUNK = 128

#: Changes with any rule below.
RULES_VERSION = 1
#: Name, pattern, group that holds the secret, least length of that group; in the order of spans that start together.
#: The last two patterns have their least length built in, which gives the same matches, as their runs can't be
#: left in the middle.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
)
#: Tells quickly that a rule can't match.
_SIFT = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each, of an array of longs."""
    empty = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), empty.alias("out"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def chunked(all_of: Column) -> Column:
        nth = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_of) / CHUNK).cast("int") - 1, F.lit(0)))
        return F.transform(nth, lambda k: F.aggregate(F.slice(all_of, k * CHUNK + 1, CHUNK), zero, add))

    def joined(chunks: Column) -> Column:
        bases = F.aggregate(F.transform(chunks, lambda c: c["sum"]), zero, add)["out"]
        return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(c["out"], lambda x: x + base)))

    return _let(lengths, lambda x: _let(chunked(x), joined))


def _spans(kind: str, text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, nth, end, kind, at>> of a rule's matches; at: where the secret itself begins."""
    nth = [k for k, *_ in RULES].index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(hits, between, lambda h, b: F.struct(F.char_length(b).alias("gap"), F.char_length(h).alias("n"))), held, lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.char_length(g).alias("held")))
    steps = F.filter(steps, lambda x: x["n"].isNotNull())

    def place(x: Column, before: Column) -> Column:
        start = (before + x["gap"]).cast("int")
        return F.struct(start.alias("start"), F.when(x["held"] < least, -1).otherwise(nth).alias("nth"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind"), (start + x["n"] - x["held"]).alias("at"))

    def placed(found: Column) -> Column:
        return F.zip_with(found, _running(F.transform(found, lambda x: (x["gap"] + x["n"]).cast("bigint"))), place)

    empty = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string,at:int>>")
    return F.when(text.rlike(_SIFT[kind]), F.filter(_let(steps, placed), lambda x: x["nth"] >= 0)).otherwise(empty)


def versions(table: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """path and blob address of every version."""
    return table.select(F.col(path).alias("path"), F.sha2(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 256).alias("blob"))


def blobs(table: DataFrame, content: str = "text") -> DataFrame:
    """Each distinct content once, with its address; copies meet in the tasks that read them first."""
    text = F.coalesce(content, F.lit(""))
    return table.select(F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"), text.alias("content")).dropDuplicates(["blob"])


def scan(contents: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows (blob, rules, spans) of the contents that the ledger lacks under this version of the rules."""
    if ledger is not None:
        seen = ledger.where(F.col("rules") == version).select("blob").distinct()
        contents = contents.join(seen, "blob", "left_anti")
    found = F.concat(*(_spans(k, F.col("content"), p, g, n) for k, p, g, n in RULES))
    return contents.select("blob", F.lit(version).alias("rules"), F.array_sort(found).alias("spans"))


def unseen(table: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION, path: str = "doc_id", content: str = "text") -> DataFrame:
    """blob and content of what the ledger lacks under this version of the rules, each once.

    With a ledger the addresses alone tell which; one row is then chosen for each blob, and only its text goes on.
    """
    if ledger is None:
        return blobs(table, content)
    new = versions(table, path, content).groupBy("blob").agg(F.min("path").alias("path"))
    new = new.join(ledger.where(F.col("rules") == version).select("blob").distinct(), "blob", "left_anti").select(F.col("blob").alias("_blob"), F.col("path").alias("_path"))
    text = F.coalesce(content, F.lit(""))
    rows = table.select(F.col(path).alias("path"), F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"), text.alias("content"))
    chosen = rows.join(new, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")
    return chosen.select("blob", "content").dropDuplicates(["blob"])


def _joined_back(table: DataFrame, ledger: DataFrame, version: int, path: str, content: str) -> DataFrame:
    by_blob = ledger.where((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return versions(table, path, content).join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def findings(table: DataFrame, path: str = "doc_id", content: str = "text", ledger: DataFrame | None = None, version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) of every version, and the ledger with this scan's rows, written in the shared folder."""
    new = materialise(scan(unseen(table, ledger, version, path, content), version=version), "secret-ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return _joined_back(table, whole, version, path, content), whole


def kept_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger kept in a folder, or None if none is there yet."""
    try:
        return spark.read.parquet(folder).select("blob", "rules", "spans")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def update(table: DataFrame, folder: str, path: str = "doc_id", content: str = "text", version: int = RULES_VERSION) -> DataFrame:
    """(path, blob, spans) of every version, by the ledger kept in the folder, to which what it lacked is added."""
    spark = table.sparkSession
    held = kept_ledger(spark, folder)
    scan(unseen(table, held, version, path, content), version=version).write.mode("append").partitionBy("rules").parquet(folder)
    return _joined_back(table, kept_ledger(spark, folder), version, path, content)


def _masked(text: Column, mark: str) -> Column:
    """text with the rules' secrets replaced, as `redact` says, in one pass for assigned secrets and one for the others."""
    _, assigned, _, least = RULES[0]
    tokens = F.regexp_extract_all(text, F.lit(assigned), F.lit(2))
    whole = F.regexp_extract_all(text, F.lit(assigned), F.lit(0))
    words = F.zip_with(whole, tokens, lambda w, g: F.when(F.char_length(g) < least, w).otherwise(F.concat(F.left(w, F.char_length(w) - F.char_length(g)), F.lit(mark))))
    pieces = F.zip_with(F.split(text, assigned, -1), words, lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))
    # of a key that ends in the first digits of a hexadecimal run the rest of the run goes too
    tails = "|".join(f"(?<=[0-9]{{{k}}})[0-9a-f]{{{24 - k},}}" for k in range(1, 24))
    return F.regexp_replace(F.array_join(pieces, ""), F.lit(rf"{RULES[1][1]}(?:{tails})?|{RULES[2][1]}"), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))


def redact(table: DataFrame, content: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """table with each secret in content replaced by the mark; null content stays null.

    Which contents hold any is told by the ledger. Overlapping spans give way to one mark; the words that introduce an
    assigned secret stay.
    """
    blob = F.sha2(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 256)
    by_blob = materialise(scan(blobs(table, content)), "secret-ledger").where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.lit(True).alias("_found"))
    held = table.withColumn("_blob", blob).join(by_blob, "_blob", "left")
    text = F.col(content)
    return held.withColumn(content, F.when(F.col("_found"), _masked(text, mark)).otherwise(text)).select(*table.columns)


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = update(read_table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger"))
    kinds = F.transform("spans", lambda x: x["kind"])
    count = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k, *_ in RULES]
    joined = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(F.encode(joined, "UTF-8"), 256).alias("base_sha256"), joined.alias("spans"))


def _spans_sql(kind: str, nth: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {nth} AS nth, list_transform(range(1, len(hits) + 1), lambda i: [coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0), length(hits[i]), length(held[i])]) AS found
 FROM (SELECT r, t, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS held, string_split_regex(t, '{p}') AS gaps FROM d)"""


#: DuckDB SQL for op3_secret_ledger.
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 k AS ({' UNION ALL '.join(_spans_sql(k, i, p, g) for i, (k, p, g, _) in enumerate(RULES))}),
 s AS (SELECT r, kind, nth, CAST(x[1] AS BIGINT) AS a, CAST(x[1] + x[2] AS BIGINT) AS b FROM (SELECT r, kind, nth, unnest(found) AS x FROM k) WHERE x[3] >= CASE WHEN kind = 'assign' THEN 6 ELSE 0 END),
 g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) AS spans FROM s GROUP BY r)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
