"""From documents to token ids: language ID, exact and near deduplication, mixing, byte-level BPE.

Each stage reads what the one before wrote. Language ID drops the documents it rejects; exact and near
deduplication leave one document of each group; mixing repeats documents of sources that are below their target
weight (no document is lost: the sources' sizes to the power of 0.7 are the weights, and the largest over-represented
source sets the total); BPE gives the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import bpe, exact, langid, minhash, mixing
from mosaiq.session import settled, spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language is not identified: null, empty and letterless texts, and texts that parse hardly
    better than random letters of their length. An empty table gives an empty one, here and in all stages."""
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, that of the least id; null texts are left alone. Of rows repeated one stays."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id; null texts and texts without words are left alone."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once or more: as often as its source's weight, the source's size to the power of 0.7, is due. A null source
    is a source; no row is lost. Rows repeated share what they are due."""
    return mixing.mixed(docs, temperature=0.7)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip), one row for each row of docs; nulls where the text is null."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Suffix automata, MinHash, random rounding and BPE are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = spread(settled(docs))  # what the stage left is not read again
    return docs
