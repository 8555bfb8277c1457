"""Embedding and generation models: native stand-ins, and providers called in Arrow batches."""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as X
from mosaiq.operators.checkpoint import exists
from mosaiq.session import written

SECRETS = ("api_key", "authorization", "token", "password", "secret")


_PASSING = ("timeout", "timed out", "time-out", "502", "503", "504", "server error", "connection reset")


def status_of(error: BaseException) -> int | None:
    """The HTTP status that an error of a client carries, on itself or on its response."""
    for holder in (error, getattr(error, "response", None)):
        try:
            return int(getattr(holder, "status_code", None))
        except (TypeError, ValueError):
            continue
    return None


def may_pass(error: BaseException) -> bool:
    """Whether a call may succeed if it is made again: not if the service has refused it (4xx but 408, 425 and 429)."""
    status = status_of(error)
    return status is None or status in (408, 425, 429) or status >= 500


def passing(error: BaseException) -> bool:
    """Whether an error is known to pass: a server's, a limit of time or calls, a broken connection."""
    status = status_of(error)
    if status is not None:
        return may_pass(error)
    return isinstance(error, (TimeoutError, ConnectionError)) or any(x in str(error).lower() for x in _PASSING)


def with_retries(call: Callable[[], Any], retries: int = 3, first: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep, again: Callable[[BaseException], bool] = may_pass) -> Any:
    """call(), up to retries times more while again(error), waiting twice as long each time."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if n == retries or not again(e):
                raise
            sleep(min(most, first * 2**n))


PART_ROWS, PART_BYTES = 256, 4 << 20


def parts(batch: pa.RecordBatch, text_col: str, step: int = 1) -> Iterator[pa.RecordBatch]:
    """batch in parts of PART_ROWS rows, or of rows with PART_BYTES of text; of a multiple of step rows but for the last."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    start = 0
    while start < batch.num_rows:
        within = int(np.searchsorted(ends, ends[start] + PART_BYTES, "right")) - 1 - start
        rows = max(1, min(-(-PART_ROWS // step), within // step)) * step
        yield batch.slice(start, rows)
        start += rows


class Embedder(ABC):
    model_name = "embedder"

    @abstractmethod
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]

    def embed(self, chunks: DataFrame, text_col: str = "text") -> DataFrame:
        """chunks with vector and embedding_model; the model runs in the executors, for PART_ROWS texts or PART_BYTES of them
        at a time, so that what a worker holds as Python objects doesn't grow with the batches that come."""
        me, step = self, getattr(self, "batch_size", 1)
        names = chunks.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts(batch, text_col, step):
                    texts = part.column(text_col).to_pylist()
                    vectors = me.embed_texts(texts)
                    if len(vectors) != len(texts):
                        raise ValueError("the model gave another number of vectors than it got texts")
                    made = [pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64())), pa.array([me.model_name] * len(texts), pa.string())]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, "vector", "embedding_model"])

        return chunks.mapInArrow(run, f"{schema}, vector array<double>, embedding_model string")


class MockEmbedder(Embedder):
    """Vectors out of hashes, as a native expression."""

    def __init__(self, dim: int = 12, model_name: str = "mock-embedder"):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.model_name = dim, model_name

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return [X.hash_vector_of(t, self.dim) for t in texts]

    def embed(self, chunks: DataFrame, text_col: str = "text") -> DataFrame:
        return chunks.withColumns({"vector": X.hash_vector(F.col(text_col), self.dim), "embedding_model": F.lit(self.model_name)})


class ProviderEmbedder(Embedder):
    """A provider's client: call(model, texts) -> [{"index": i, "embedding": [...]}], batched, retried, in order."""

    def __init__(self, call: Callable[[str, list[str]], list[dict[str, Any]]], model: str, batch_size: int = 32, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.call, self.model_name, self.batch_size, self.retries, self.sleep = call, model, batch_size, retries, sleep

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch_size):
            part = texts[i : i + self.batch_size]
            data = with_retries(lambda p=part: self.call(self.model_name, p), self.retries, sleep=self.sleep)
            rows = sorted(data, key=lambda r: r.get("index", 0))
            if len(rows) != len(part) or any(not r.get("embedding") for r in rows):
                raise ValueError("the provider left out vectors")
            out += [list(map(float, r["embedding"])) for r in rows]
        return out


def embed_cached(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, new cache rows). The model sees each distinct text once, and no text the cache has."""
    hashed = chunks.withColumn("text_hash", X.text_hash(F.col(text_col)))
    texts = hashed.select("text_hash", F.col(text_col).alias("text")).dropDuplicates(["text_hash"])
    known = cache.where(F.col("model") == embedder.model_name).select("text_hash", "vector").dropDuplicates(["text_hash"]) if cache is not None else None
    if known is not None:
        # only what these texts ask for, fixed before the cache grows
        known = written(known.join(texts.select("text_hash"), "text_hash", "left_semi"))
    if known is not None:
        texts = texts.join(known, "text_hash", "left_anti")
    new = written(embedder.embed(texts, "text").select("text_hash", F.lit(embedder.model_name).alias("model"), "vector"))
    vectors = new.select("text_hash", "vector")
    if known is not None:
        vectors = vectors.unionByName(known.select("text_hash", F.col("vector").cast("array<double>")))
    return hashed.join(vectors, "text_hash").drop("text_hash").withColumn("embedding_model", F.lit(embedder.model_name)), new


def load_cache(lines: DataFrame, model: str) -> DataFrame:
    """(text_hash, model, vector) of a cache log (text_hash, model, vector, line_no): the last line of each hash."""
    return lines.where(F.col("model") == model).groupBy("text_hash").agg(F.first("model").alias("model"), F.max_by("vector", "line_no").alias("vector"))


class EmbeddingCache:
    """An append-only folder of JSON lines {text_hash, model, vector}."""

    SCHEMA = "text_hash string, model string, vector array<double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def lines(self) -> DataFrame:
        """The log with line_no, which orders lines: later appends after earlier ones."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{self.SCHEMA}, line_no struct<a:timestamp,b:string,c:bigint>")
        read = self.spark.read.schema(self.SCHEMA).json(self.path)
        order = F.struct(F.col("_metadata.file_modification_time").alias("a"), F.col("_metadata.file_name").alias("b"), F.monotonically_increasing_id().alias("c"))
        return read.withColumn("line_no", order)

    def vectors(self, model: str) -> DataFrame:
        return load_cache(self.lines(), model)

    def append(self, rows: DataFrame) -> None:
        rows.select("text_hash", "model", "vector").write.mode("append").json(self.path)


class CachedEmbedder(Embedder):
    """An embedder whose vectors go through a cache: the model sees no text that the cache has, and each other one once."""

    def __init__(self, embedder: Embedder, cache: EmbeddingCache):
        self.embedder, self.cache, self.model_name = embedder, cache, embedder.model_name

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return self.embedder.embed_texts(texts)

    def embed(self, chunks: DataFrame, text_col: str = "text") -> DataFrame:
        out, new = embed_cached(chunks, self.embedder, self.cache.vectors(self.model_name), text_col)
        self.cache.append(new)
        return out


class Generator(ABC):
    model_name = "generator"

    @abstractmethod
    def generate(self, query_text: str, texts: list[str], instructions: str | None = None, model: str | None = None, **params: Any) -> str: ...

    def metadata(self) -> dict[str, Any]:
        return {}

    def respond(self, rows: DataFrame, instructions: str | None = None, model: str | None = None, **params: Any) -> DataFrame:
        """rows (query_text, texts, ...) with response_text and metadata (JSON); a failure of one row is its error."""
        me = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, notes = [], []
                for q, t in zip(pdf["query_text"], pdf["texts"]):
                    try:
                        texts.append(me.generate(q, list(t) if t is not None else [], instructions, model=model, **params))
                        notes.append(json.dumps(redacted(me.metadata()), sort_keys=True, default=str) if me.metadata() else "")
                    except Exception as e:  # one cell's failure must not end the others
                        texts.append("")
                        notes.append(json.dumps({"error": str(e)}))
                yield pdf.assign(response_text=texts, metadata=notes)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{schema}, response_text string, metadata string")


class MockGenerator(Generator):
    """Responses as a native expression."""

    def __init__(self, model_name: str = "mock-generator"):
        self.model_name = model_name

    def generate(self, query_text: str, texts: list[str], instructions: str | None = None, model: str | None = None, **params: Any) -> str:
        if not query_text:
            raise ValueError("a question is needed")
        note = f" Instructions: {instructions.strip()}" if instructions else ""
        return f"[MOCK RESPONSE] Query: {query_text}. Chunks: {len(texts)}. Snippet: {(texts[0][:120] if texts else '').replace(chr(10), ' ')}.{note}"

    def respond(self, rows: DataFrame, instructions: str | None = None, model: str | None = None, **params: Any) -> DataFrame:
        return rows.withColumns({"response_text": X.mock_response(F.col("query_text"), F.col("texts"), instructions), "metadata": F.lit("")})


class ProviderGenerator(Generator):
    """A provider's chat client: call(model, messages, **params) -> text or {"choices": [{"message": {"content"}}]}."""

    def __init__(self, call: Callable[..., Any], model: str, system_prompt: str = X.SYSTEM_PROMPT, retries: int = 3, sleep: Callable[[float], None] = time.sleep, **default_params: Any):
        self.call, self.model_name, self.system_prompt, self.retries, self.sleep = call, model, system_prompt, retries, sleep
        self.default_params = default_params
        self.last: dict[str, Any] = {}

    def messages(self, query_text: str, texts: list[str], instructions: str | None) -> list[dict[str, str]]:
        context = "\n\n".join(f"[Chunk {i}]\n{t}" for i, t in enumerate(texts, 1)) or X.NO_CONTEXT
        block = f"\n\nAdditional instructions: {instructions.strip()}" if instructions else ""
        return [{"role": "system", "content": self.system_prompt}, {"role": "user", "content": X.PROMPT_TEMPLATE.format(context=context, question=query_text, instructions_block=block)}]

    def generate(self, query_text: str, texts: list[str], instructions: str | None = None, model: str | None = None, **params: Any) -> str:
        if not query_text:
            raise ValueError("a question is needed")
        used = {**self.default_params, **params}
        name = model or self.model_name
        got = with_retries(lambda: self.call(name, self.messages(query_text, texts, instructions), **used), self.retries, sleep=self.sleep)
        self.last = {"model": name, "prompt_version": X.PROMPT_VERSION, "system_prompt": self.system_prompt, "params": redacted(used)}
        return got if isinstance(got, str) else got["choices"][0]["message"]["content"]

    def metadata(self) -> dict[str, Any]:
        return self.last


def redacted(value: Any) -> Any:
    """value without the contents of fields whose names say that they are secret."""
    if isinstance(value, dict):
        return {k: "***" if any(s in str(k).lower() for s in SECRETS) and not str(k).lower().startswith("max_") else redacted(v) for k, v in value.items()}
    return value




