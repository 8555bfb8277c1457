"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import bpe, exact, langid, lm, media, minhash, mixing, pii, secret_scan, shard
from mosaiq.session import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, range-partitioned into a folder of the shared one."""
    return shard.sharded(_docs(spark, sf_dir), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


QUERIES: dict[str, Query] = {
    "op1_secret_scan": lambda s, d: secret_scan.secret_scan(_docs(s, d)),
    "op2_media_columns": lambda s, d: media.png_hashes(media.render_pages(spread(s.read.parquet(f"{d}/pages.parquet")))),
    "op3_mixing": lambda s, d: mixing.mix_copies(_docs(s, d)),
    "op4_byte_bpe": lambda s, d: bpe.bpe_encode(_docs(s, d)),
    "op5_pii": lambda s, d: pii.pii_spans(_docs(s, d)),
    "op6_minhash_near_dedup": lambda s, d: minhash.near_groups(_docs(s, d)),
    "op7_lm_scoring": lambda s, d: lm.lm_scores(_docs(s, d)),
    "op8_exact_dedup": lambda s, d: exact.exact_groups(_docs(s, d)),
    "op9_sharding": _shards,
    "op10_language_id": lambda s, d: langid.identify_language(_docs(s, d)),
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.oracle(),
    "op8_exact_dedup": exact.ORACLE,
}
