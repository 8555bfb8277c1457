"""The chainable facade: read, clean, chunk, embed, index, compare, export. Every step is lazy until a sink."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.config import EngineConfig
from mosaiq.functions import text as X
from mosaiq.operators import cells, chunking, export
from mosaiq.operators.batch import BatchManager, BatchState
from mosaiq.operators.checkpoint import Checkpoint
from mosaiq.operators.compare import QuerySpec, Runner
from mosaiq.operators.models import CachedEmbedder, Embedder, EmbeddingCache, Generator, MockEmbedder, MockGenerator
from mosaiq.operators.store import ChunkStore, VectorStore
from mosaiq.session import written
from mosaiq.sources import files

_CHUNK = ("chunk_id", "document_id", "text", "chunk_index", "start_char", "end_char", "vector", "embedding_model")


def setup_logging(level: str = "INFO", path: str | None = None) -> logging.Logger:
    log = get_logger()
    log.setLevel(level)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


def get_logger(name: str = "mosaiq") -> logging.Logger:
    return logging.getLogger(name)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.documents: DataFrame | None = None
        self.chunks: DataFrame | None = None
        self.embedded: DataFrame | None = None
        self.store: VectorStore | None = None
        self.embedder: Embedder | None = None
        self.responses: DataFrame | None = None

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, text_column: str, metadata_columns: list[str] | None = None, **options: Any) -> Engine:
        return cls.from_documents(files.read_csv(spark, path, text_column, metadata_columns, **options))

    @classmethod
    def from_txt_directory(cls, spark: SparkSession, path: str, **options: Any) -> Engine:
        return cls.from_documents(files.read_text_folder(spark, path, **options))

    @classmethod
    def from_pdf(cls, spark: SparkSession, path: str) -> Engine:
        return cls.from_documents(files.read_pdf(spark, path))

    @classmethod
    def from_documents(cls, documents: DataFrame, config: EngineConfig | None = None) -> Engine:
        engine = cls(documents.sparkSession, config)
        engine.documents = documents
        return engine

    @classmethod
    def from_config(cls, spark: SparkSession, config: EngineConfig) -> Engine:
        c = config.ingestion
        docs = files.ingest(spark, c.directory_path, c.format, c.text_column, c.metadata_columns, c.document_id_column, c.encoding, c.auto_generate_ids)
        return cls.from_documents(docs, config)

    def _need(self, what: str) -> DataFrame:
        value = getattr(self, what)
        if value is None:
            raise ValueError(f"no {what} yet")
        return value

    @property
    def meta(self) -> list[str]:
        return [c for c in self._need("chunks").columns if c not in _CHUNK]

    def clean(self, clean_fn=None, preserve_raw: bool = False, python: bool = False) -> Engine:
        docs, c = self._need("documents"), self.config.cleaning
        if clean_fn is None:
            def clean_fn(col):
                col = X.clean_extras(col, c.strip_urls, c.strip_emails, c.lowercase, tuple(c.header_footer_patterns))
                return X.clean(col) if c.normalize_whitespace else col
            python = False
        self.documents = chunking.clean_documents(docs, clean_fn, preserve_raw, python)
        return self

    def chunk(self, size: int | None = None, overlap: int | None = None, chunk_fn=None, python: bool = True) -> Engine:
        docs, c = self._need("documents"), self.config.chunking
        overlap = c.chunk_overlap if overlap is None else overlap
        if chunk_fn is None and c.method == "sentence":
            chunk_fn, python = chunking.sentences, False
        self.chunks = chunking.custom_chunks(docs, chunk_fn, overlap, python) if chunk_fn else chunking.chunks(docs, c.chunk_size if size is None else size, overlap)
        return self

    def embed(self, embedder: Embedder | None = None, cache_path: str | None = None, resume: bool = True) -> Engine:
        """Vectors for the chunks, written, so that the model runs once however often they are used. With a cache (its
        path given or in the configuration) texts that it has are not embedded again; resume=False leaves it unread."""
        c = self.config.embedding
        model = embedder or self.embedder or MockEmbedder(model_name=c.model)
        path = cache_path or c.cache_path
        if path:
            cache = EmbeddingCache(self.spark, path)
            model = CachedEmbedder(model, cache) if resume else model
        self.embedder = model
        self.embedded = written(model.embed(self._need("chunks")))
        if path and not resume:
            texts = self.embedded.dropDuplicates(["text"])
            cache.append(texts.select(X.text_hash(F.col("text")).alias("text_hash"), F.col("embedding_model").alias("model"), "vector"))
        return self

    def embed_batch(self, client, state: BatchState | None = None, store: ChunkStore | None = None, resume: bool = False, **options: Any) -> list:
        """Embed through a provider's batches; state is made of the configuration where none is given. resume: go on with
        what was prepared under the state's root, without preparing it anew."""
        b = self.config.batch_embedding
        state = state or BatchState(b.output_dir, self.config.embedding.model, b.provider, b.completion_window, b.max_lines_per_jsonl, b.max_bytes_per_jsonl, b.poll_seconds)
        self.store = store or self.store or ChunkStore(self.spark, state.path("store"))
        manager = BatchManager.from_state(self.spark, state.root, client, self.store, **options) if resume else BatchManager(self.spark, state, self.store, client, **options)
        if not resume:
            manager.prepare(self._need("chunks"), ["document_id", "chunk_index"])
        manager.submit()
        return manager.poll()

    def index(self, path: str | None = None, store: VectorStore | None = None, **options: Any) -> Engine:
        rows = self._need("embedded")
        self.store = store or ChunkStore(self.spark, path or self.config.vector_store.path, self.config.vector_store.partition_by)
        self.store.add(rows, self.meta, ["document_id", "chunk_index"], **options)
        self.store.persist()
        return self

    def compare(self, queries: str | list[str] | list[QuerySpec], cell_fields: list[str] | None = None, generator: Generator | None = None, k: int | None = None, checkpoint_path: str | None = None, resume: bool = False, base: dict[str, Any] | None = None, generation_model: str | None = None, instructions: str | None = None, embedder: Embedder | None = None) -> Engine:
        if resume and not checkpoint_path:
            raise ValueError("resume needs checkpoint_path")
        c = self.config
        specs = []
        for q in [queries] if isinstance(queries, str) else queries:
            if isinstance(q, str):
                if not cell_fields:
                    raise ValueError("text queries need cell_fields")
                q = QuerySpec(q, cell_fields, retrieval_k=k or c.retrieval.k, additional_instructions=instructions, generation_model=generation_model or c.generation.model)
            specs.append(q)
        source = self.store.read() if self.store else self._need("embedded")
        order = ["seq"] if self.store else ["document_id", "chunk_index"]
        model = embedder or self.embedder
        if model is None:
            raise ValueError("no embedder yet")
        generator = generator or MockGenerator()
        if c.generation.system_prompt and hasattr(generator, "system_prompt"):
            generator.system_prompt = c.generation.system_prompt
        runner = Runner(source, model, generator, c.retrieval.metric, order, c.retrieval.min_score)
        checkpoint = Checkpoint(self.spark, checkpoint_path) if checkpoint_path else None
        answers = runner.run(specs, self.chunks if self.store else None, base, checkpoint, resume)
        self.responses = answers if checkpoint else written(answers)  # ids, times and the generator's answers stay as they are
        return self

    def construct_cells(self, fields: list[str]) -> DataFrame:
        return cells.construct_cells(self._need("chunks"), fields, ["document_id", "chunk_index"])

    def get_metadata_values(self, fields: list[str]) -> DataFrame:
        return cells.list_metadata_values(self._need("chunks"), fields)

    def export_chunks(self, path: str | None = None, format: str | None = None, **options: Any) -> Engine:
        c = self.config.export
        export.export_chunks(self._need("chunks"), path or self._output("chunks"), format or c.format, self.meta, **{"include_text": c.include_retrieved_text, **options})
        return self

    def export_responses(self, path: str | None = None, format: str | None = None, **options: Any) -> Engine:
        c = self.config.export
        export.export_responses(self._need("responses"), path or self._output("responses"), format or c.format, **{"include_context": c.include_retrieved_text, **options})
        return self

    def _output(self, name: str) -> str:
        if not self.config.export.output_path:
            raise ValueError("an export needs a path")
        return f"{self.config.export.output_path.rstrip('/')}/{name}"

    def chunks_per_cell(self, fields: list[str]) -> DataFrame:
        return self._need("chunks").groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
