"""Exports of chunks and responses: CSV, JSON lines, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.text import truncate
from mosaiq.operators.checkpoint import iso

_CHUNK = ["chunk_id", "document_id", "chunk_index", "start_char", "end_char"]
_CORE = ["response_id", "query_id", "query_text", "cell_id", "retrieved_chunk_ids", "retrieved_context", "response_text", "model_name", "embedding_model_name", "timestamp", "metadata"]


def flat_chunks(chunks: DataFrame, meta: list[str] | None = None, include_text: bool = True) -> DataFrame:
    meta = meta if meta is not None else [c for c in chunks.columns if c not in (*_CHUNK, "text", "vector")]
    return chunks.select(*_CHUNK, *(["text"] if include_text else []), *meta)


def chunk_lines(chunks: DataFrame, meta: list[str] | None = None, include_text: bool = True) -> DataFrame:
    """(value): a JSON object for each chunk, metadata nested, nulls written."""
    meta = meta if meta is not None else [c for c in chunks.columns if c not in (*_CHUNK, "text", "vector")]
    inner = F.struct(*[F.col(f"`{m}`") for m in meta]).alias("metadata") if meta else F.create_map().cast("map<string,string>").alias("metadata")
    return chunks.select(F.to_json(F.struct("chunk_id", "document_id", "chunk_index", "start_char", "end_char", *(["text"] if include_text else []), inner), {"ignoreNullFields": "false"}).alias("value"))


def flat_responses(responses: DataFrame, include_context: bool = True) -> DataFrame:
    fields = [c for c in responses.columns if c not in _CORE]
    return responses.select(
        "response_id", "query_id", "query_text", "cell_id", "response_text", "model_name", F.col("embedding_model_name").alias("embedding_model"),
        F.coalesce(F.size("retrieved_chunk_ids"), F.lit(0)).alias("retrieved_chunk_count"), iso().alias("timestamp"),
        *(["retrieved_context"] if include_context else []), *fields, F.coalesce("metadata", F.lit("")).alias("metadata"),
    )


def preview(responses: DataFrame, width: int = 140) -> DataFrame:
    """The cell's fields and the answer cut to width, as a table for display."""
    fields = [c for c in responses.columns if c not in _CORE]
    return responses.select(*fields, truncate(F.col("response_text"), width).alias("Response"))


def response_lines(responses: DataFrame) -> DataFrame:
    """(value): a JSON object of twelve fields for each response, the cell and the ids nested."""
    fields = [c for c in responses.columns if c not in _CORE]
    cell = F.struct(*fields).alias("cell_filter") if fields else F.create_map().cast("map<string,string>").alias("cell_filter")
    return responses.select(F.to_json(F.struct("response_id", "query_id", "query_text", "cell_id", cell, "retrieved_chunk_ids", "retrieved_context", "response_text", "model_name", "embedding_model_name", iso().alias("timestamp"), "metadata"), {"ignoreNullFields": "false"}).alias("value"))


def _csv(df: DataFrame, path: str, single: bool) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("escape", '"').option("lineSep", "\n").csv(path, header=True)


def export_chunks(chunks: DataFrame, path: str, format: str = "csv", meta: list[str] | None = None, include_text: bool = True, single: bool = False) -> None:
    """single makes one file; without it each task writes its own, which is what large tables need."""
    if format == "csv":
        _csv(flat_chunks(chunks, meta, include_text), path, single)
    elif format == "json":
        lines = chunk_lines(chunks, meta, include_text)
        (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
    elif format == "parquet":
        flat_chunks(chunks, meta, include_text).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported format: {format}")


def export_responses(responses: DataFrame, path: str, format: str = "csv", include_context: bool = True, single: bool = False) -> None:
    if format == "csv":
        _csv(flat_responses(responses, include_context), path, single)
    elif format == "json":
        lines = response_lines(responses)
        (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
    elif format == "parquet":
        flat_responses(responses, include_context).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported format: {format}")
