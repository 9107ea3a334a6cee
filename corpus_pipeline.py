"""From documents to token ids: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; its result is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm import bpe, language, minhash, mixing, secrets
from joinloom.llm.common import discard, read_table, written

#: A document goes if no language that it is like has this share of its letters.
LEAST_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no learned language; where nothing can be learned, all stay."""
    model = language.fit(docs)
    if not model.languages:
        return docs
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows the mixture takes, each as often as it takes it."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"], want=("token_ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("tokens", tokenise),
]

#: Sampling by near-null-space steps and merging by ranks can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)  # what the stage has read
        before = [docs]
    return docs
