"""The pipeline, stage by stage."""

import random
import re

import corpus_pipeline
from strataflow.llm import queries
from strataflow.session import materialise, read_table


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents")
    columns, sizes = docs.columns, [docs.count()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, d), "test-stage")
        assert docs.columns == columns and docs.schema["doc_id"].dataType.simpleString() == "bigint"
        sizes.append(docs.count())
        if name == "near dedup":
            kept = [r.text for r in docs.collect()]
            assert len(kept) == len(set(kept))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    left = docs.collect()
    assert not [r for r in left if re.search(r'token = "[0-9a-f]{40}', r.text)]
    assert all(r.text == texts[r.doc_id] or "<SECRET>" in r.text for r in left) and all(r.n_chars == len(r.text) for r in left)
    labels = {r.doc_id: r for r in read_table(spark, d, "labels").collect()}
    assert sum(labels[r.doc_id].quality == 0 for r in left if r.doc_id in labels) <= 5
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == sizes[-1]


def test_near_dedup_is_by_similarity(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for g in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(64)]
        shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        # 48 of 60 shingles (0.8), 47 of 60, and two changed words: 50 of 70
        for k, cut in enumerate((52, 51, 64)):
            other = words[:cut] if cut < 64 else [*words[:20], "x", *words[21:40], "y", *words[41:]]
            a, b = shingles(words), shingles(other)
            pairs.append((6 * g + 2 * k, 6 * g + 2 * k + 1, len(a & b) / len(a | b)))
            rows += [(6 * g + 2 * k, " ".join(f"{w}{k}" for w in words), "en", "s", 1), (6 * g + 2 * k + 1, " ".join(f"{w}{k}" for w in other), "en", "s", 1)]
    rows += [(1000, "one two three four five six seven " * 30, "en", "s", 1), (1001, "one two three four five six seven " * 3, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {0.8} & {p for *_, p in pairs} and min(p for *_, p in pairs) < 0.8
    assert kept == {i for i, _, _ in pairs} | {j for _, j, p in pairs if p < 0.8} | {1000}


def test_edges(spark, edges, empty):
    for docs in (edges.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())), name
