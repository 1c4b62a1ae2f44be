"""A pipeline over documents: language ID, quality rules, near-duplicates, mixing, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on, as a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Nulls, empty tables and repeated rows are handled as the operators define; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm import bpe, jaccard, language, mixing, quality
from rulespark.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language of the labelled documents; their lang column counts as declaration, source as host."""
    docs = docs.select(*COLUMNS)
    return language.keep_languages(docs, language.fit(docs), declared_col="lang", host_col="source")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.keep_quality(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the output shards."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, path, vocabularies.PATTERN, decoded_col="decoded")
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Banding, the language model and BPE have no SQL; tests hold the stages after the first against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
