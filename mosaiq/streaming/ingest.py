"""Documents that keep arriving: a stream of files, chunked, embedded and added to a store exactly once by chunk id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mosaiq.operators import chunking
from mosaiq.operators.models import Embedder
from mosaiq.operators.store import ChunkStore, skip_existing


def stream_documents(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_chunks(docs: DataFrame, size: int = 750, overlap: int = 100, meta: list[str] | None = None) -> DataFrame:
    """Cleaned chunks of a stream: projections and an explode, no state."""
    return chunking.chunks(chunking.clean_documents(docs), size, overlap, meta=meta)


def index_stream(chunks: DataFrame, embedder: Embedder, store: ChunkStore, meta: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add a stream's chunks to the store. A batch that is run again adds nothing: ids in the store are left out."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["chunk_id"])
        if store.exists():
            rows = skip_existing(rows, store.ids())
        if not rows.isEmpty():
            store.add(embedder.embed(rows), meta, ["document_id", "chunk_index"])

    writer = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
