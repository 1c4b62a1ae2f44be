"""The pipeline as a whole, its stages' decisions, and the queries' SQL."""

import hashlib
import struct
from collections import Counter

import public_tokenizers as vocabularies
import pytest

import corpus_pipeline
from rulespark.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, rows, SF).toPandas(), docs.schema)
        assert out.columns == docs.columns, name
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name.startswith("mixing"):
            assert max(ids.values()) <= 2
        else:
            assert max(ids.values()) == 1 and len(ids) <= n
        rows, n = out, len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in rows.select("doc_id").collect())


def test_run_equals_stages(spark):
    found = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, SF).toPandas())
    assert found == Counter(tuple(r) for r in rows.collect())


def test_messy_documents(spark, messy, nothing):
    for docs in (messy, nothing):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            rows = spark.createDataFrame(out.collect(), out.schema)
            if name != "byte-level BPE":
                assert tuple(rows.columns) == corpus_pipeline.COLUMNS


def test_decoding_gives_texts_back(spark):
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs, path, vocabularies.PATTERN), path).collect()}
    assert found == {r.doc_id: r.text for r in docs.collect()}


def test_stages_equal_plain_versions(spark):
    """Quality against SQL, duplicates against all pairs, mixing against targets, BPE against the library; each on its input."""
    import duckdb
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from test_corpus_operators import plain_links, plain_targets

    def step(k, rows):
        out = corpus_pipeline.STAGES[k][1](spark, rows, SF)
        return out.toPandas(), out.schema

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said, schema = step(0, docs)
    documents = said  # a view by name
    con = duckdb.connect()
    con.register("documents", documents)
    from rulespark.llm.sql import SQL

    fine, _ = step(1, spark.createDataFrame(said, schema))
    want = con.execute(f"SELECT doc_id FROM ({SQL['op6_quality_rules']}) WHERE kept").fetchall()
    assert sorted(fine.doc_id) == sorted(r[0] for r in want)

    once, _ = step(2, spark.createDataFrame(fine, schema))
    root, _ = plain_links(list(zip(fine.doc_id.tolist(), fine.text, strict=True)))
    assert sorted(root[i] for i in once.doc_id.tolist()) == sorted({root[i] for i in fine.doc_id.tolist()})

    mixed, _ = step(3, spark.createDataFrame(once, schema))
    sizes, taken = Counter(), Counter()
    for rows, into in ((once, sizes), (mixed, taken)):
        for source, text in zip(rows.source, rows.text, strict=True):
            into[source] += len(text.encode().split())
    longest = max(len(t.encode().split()) for t in once.text)
    assert all(abs(taken[s] - t) <= longest for s, t in plain_targets(sizes).items())

    last, _ = step(4, spark.createDataFrame(mixed, schema))
    ranks = load_tiktoken_bpe(vocabularies.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in zip(mixed.doc_id.tolist(), mixed.text, strict=True):
        ids = plain.encode_ordinary(t)
        want.append((i, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(t.encode())))
    assert sorted(tuple(r) for r in last.itertuples(index=False)) == sorted(want)


@pytest.mark.parametrize("name", ["op5_mix_sources", "op6_quality_rules", "op10_exact_topk"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from rulespark.llm import entry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(result.fetchall())
