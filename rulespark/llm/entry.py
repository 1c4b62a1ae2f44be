"""The subpackage's queries, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm import bpe, chat, jaccard, language, mixing, ngram_lm, quality, records, topk, toxicity
from rulespark.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(table(spark, sf_dir, "documents"), path, vocabularies.PATTERN, decoded_col="decoded")
    n = F.expr("length(ids) div 4").alias("n_tokens")
    return found.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    folder = records.write_records(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), end_id=2)
    found = records.read_records(spark, folder)
    return found.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digest_chat(chat.format_chat(rows.unionByName(more)), dealt=True)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.digest_mix(table(spark, sf_dir, "documents"))
    names = {"mix_id": "doc_id", "mix_words": "size", "mix_size": "source_size", "mix_target": "target", "mix_taken": "taken", "mix_times": "times"}
    return found.select(*[F.col(c).alias(n) for c, n in names.items()])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ngram_lm.held_out(F.col("doc_id"))
    found = ngram_lm.score(docs, ngram_lm.fit(docs.where(~out), order=3))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    found = language.identify(table(spark, sf_dir, "pages"), model, id_col="page_id", text_col="html", markup=True, url_col="url")
    return found.drop("row_key", "row_size")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_binary_records, op3_chat_windows, op4_ngram_jaccard_join, op5_mix_sources, op6_quality_rules, op7_lm_scoring, op8_toxicity, op9_language_id, op10_exact_topk)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  it belongs to the subpackage: without it there are no queries

    return {"pipeline": pipeline, **QUERIES}


def oracle_sql() -> dict[str, str]:
    from rulespark.llm.sql import SQL

    return dict(SQL)
