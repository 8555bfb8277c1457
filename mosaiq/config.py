"""Settings as dataclasses; Engine.from_config runs by them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class IngestionConfig:
    format: str = "csv"
    text_column: str | None = None
    metadata_columns: list[str] = field(default_factory=list)
    directory_path: str | None = None
    document_id_column: str | None = None
    auto_generate_ids: bool = True
    encoding: str = "utf-8"


@dataclass
class CleaningConfig:
    normalize_whitespace: bool = True
    header_footer_patterns: list[str] = field(default_factory=list)
    strip_urls: bool = False
    strip_emails: bool = False
    lowercase: bool = False


@dataclass
class ChunkingConfig:
    chunk_size: int = 750
    chunk_overlap: int = 100
    method: str = "character"


@dataclass
class EmbeddingConfig:
    model: str = "mock-embedder"
    cache_path: str | None = None


@dataclass
class BatchEmbeddingConfig:
    provider: str = "openai"
    completion_window: str = "24h"
    output_dir: str = ".batch"
    max_lines_per_jsonl: int = 5000
    max_bytes_per_jsonl: int = 20 << 20
    poll_seconds: int = 20


@dataclass
class VectorStoreConfig:
    path: str | None = None
    partition_by: list[str] = field(default_factory=list)


@dataclass
class RetrievalConfig:
    k: int = 5
    metric: str = "cosine"
    min_score: float | None = None


@dataclass
class GenerationConfig:
    model: str | None = None
    system_prompt: str | None = None


@dataclass
class ExportConfig:
    format: str = "csv"
    output_path: str | None = None
    include_retrieved_text: bool = True


@dataclass
class EngineConfig:
    ingestion: IngestionConfig = field(default_factory=IngestionConfig)
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    batch_embedding: BatchEmbeddingConfig = field(default_factory=BatchEmbeddingConfig)
    vector_store: VectorStoreConfig = field(default_factory=VectorStoreConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    export: ExportConfig = field(default_factory=ExportConfig)
