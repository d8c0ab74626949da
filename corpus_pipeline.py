"""A corpus from raw documents to packed token sequences, in four stages.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept. All but the last return the columns of ``documents``, so other columns don't come along,
whatever their names.

Defined cases: language ID drops null and empty texts (without a letter); the other stages keep
them: they are in no group of near duplicates, hold no secret and pack as their end id alone.
Rows without id stay until the end. Whole texts of any length count. Of a group of near
duplicates, repeated rows included, the smallest id stays; rows of one id with different texts
are documents of their own. Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import language_id, near_duplicates, packing, secrets
from loomspark.llm.common import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that a trained class of none of the languages
    fits best; ``lang`` takes the predicted language where it is null."""
    seen = language_id.predict(docs.select(*COLUMNS), language_id.fit(docs, other=True))
    kept = seen.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near duplicates."""
    return near_duplicates.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Language, near-duplicate and packing decisions can't be expressed in SQL; the tests hold
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
