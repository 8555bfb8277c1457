"""Comparative queries: the same question in every cell, as one distributed plan."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as X
from mosaiq.operators.cells import cell_id, construct_cells
from mosaiq.operators.checkpoint import Checkpoint
from mosaiq.operators.models import Embedder, Generator
from mosaiq.operators.retrieval import per_cell
from mosaiq.session import written

#: Columns of a response besides the cell's fields.
RESPONSE = ["response_id", "query_id", "query_text", "cell_id", "retrieved_chunk_ids", "retrieved_context", "response_text", "model_name", "embedding_model_name", "timestamp", "metadata"]


@dataclass
class QuerySpec:
    query_text: str
    cell_fields: list[str] = field(default_factory=list)
    query_id: str = ""
    retrieval_k: int = 5
    additional_instructions: str | None = None
    generation_model: str | None = "gpt-3.5-turbo"
    generation_params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.query_id:  # the same question, asked alike, gets the same id, so a run can be resumed
            told = json.dumps([self.query_text, self.cell_fields, self.retrieval_k, *self.asked], sort_keys=True, default=str)
            self.query_id = hashlib.sha256(told.encode()).hexdigest()[:32]

    @property
    def asked(self) -> tuple[str, str, str]:
        """What the generator is told besides the question: instructions, model and parameters, as JSON."""
        return tuple(json.dumps(x, sort_keys=True, default=str) for x in (self.additional_instructions, self.generation_model, self.generation_params))


def contexts(top: DataFrame, fields: list[str], frame: DataFrame | None = None, order_col: str = "rank") -> DataFrame:
    """(query_id, *fields, chunk_ids, texts) in rank order; frame adds rows for cells nothing was found in."""
    got = top.groupBy("query_id", *fields).agg(F.array_sort(F.collect_list(F.struct(order_col, "chunk_id", "text"))).alias("mq_hits"))
    got = got.select("query_id", *fields, F.transform("mq_hits", lambda h: h["chunk_id"]).alias("chunk_ids"), F.transform("mq_hits", lambda h: h["text"]).alias("texts"))
    if frame is None:
        return got
    none = F.array().cast("array<string>")
    return frame.join(got, ["query_id", *fields], "left").withColumns({"chunk_ids": F.coalesce("chunk_ids", none), "texts": F.coalesce("texts", none)})


class Runner:
    """Runs questions over cells. Ties in scores go by the order columns, so results don't depend on partitions."""

    def __init__(self, store: DataFrame, embedder: Embedder, generator: Generator, metric: str = "cosine", order: list[str] | None = None, min_score: float | None = None):
        self.store, self.embedder, self.generator, self.metric, self.order, self.min_score = store, embedder, generator, metric, order, min_score

    def run(self, specs: list[QuerySpec], cells_from: DataFrame | None = None, base: dict[str, Any] | None = None, checkpoint: Checkpoint | None = None, resume: bool = False, retry_errors: bool = False, waves: int = 4) -> DataFrame:
        """Responses of all questions, those with the same cell fields that are asked alike in one plan. With resume, what
        is in the checkpoint is neither answered nor returned. A checkpoint gets the answers in waves, so a run that
        breaks off has lost one wave at most."""
        if resume and checkpoint is None:
            raise ValueError("resume needs a checkpoint")
        if len({s.query_id for s in specs}) < len(specs):
            raise ValueError("two queries have one query_id")
        groups: dict[tuple, list[QuerySpec]] = {}
        for s in specs:
            if not s.query_text or not s.cell_fields:
                raise ValueError("a query needs a text and cell fields")
            groups.setdefault((tuple(s.cell_fields), s.asked), []).append(s)
        parts = []
        for (fields, _), group in groups.items():
            rows = self._group(list(fields), group, cells_from, base, checkpoint if resume else None, retry_errors)
            if checkpoint is None:
                parts.append(self._answered(rows, group[0], list(fields)))
                continue
            rows = written(rows)  # retrieval runs once, for all waves
            for w in range(waves):
                some = rows.where(F.pmod(F.xxhash64("query_id", "cell_id"), F.lit(waves)) == w)
                parts.append(checkpoint.append(self._answered(some, group[0], list(fields))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _group(self, fields: list[str], specs: list[QuerySpec], cells_from: DataFrame | None, base: dict[str, Any] | None, done: Checkpoint | None, retry_errors: bool) -> DataFrame:
        """(query_id, query_text, cell_id, *fields, chunk_ids, texts) of the cells that are to be answered."""
        spark = self.store.sparkSession
        questions = spark.createDataFrame([(s.query_id, s.query_text) for s in specs], "query_id string, query_text string")
        vectors = [{"query_id": s.query_id, "vector": self.embedder.embed_query(s.query_text), "k": s.retrieval_k} for s in specs]
        left = done.processed(retry_errors) if done is not None else None
        if cells_from is None and base is None and self.min_score is None and all(s.retrieval_k > 0 for s in specs):
            # each cell of the store has chunks that are found, so what is found tells the cells
            rows = contexts(per_cell(self.store, fields, vectors, None, None, self.metric, self.order), fields).join(questions, "query_id")
            rows = rows.select("query_id", "query_text", cell_id(rows, fields).alias("cell_id"), *fields, "chunk_ids", "texts")
            return rows.join(left, ["query_id", "cell_id"], "left_anti") if left is not None else rows
        cells = construct_cells(cells_from if cells_from is not None else self.store, fields)
        asked = F.array(*[F.struct(F.lit(s.query_id).alias("query_id"), F.lit(s.query_text).alias("query_text")) for s in specs])
        frame = cells.select("*", F.inline(asked))
        if left is not None:
            frame = frame.join(left, ["query_id", "cell_id"], "left_anti")
        top = per_cell(self.store, fields, vectors, base, cells if cells_from is not None else None, self.metric, self.order, min_score=self.min_score)
        return contexts(top, fields, frame)

    def _answered(self, rows: DataFrame, first: QuerySpec, fields: list[str]) -> DataFrame:
        answered = self.generator.respond(rows, first.additional_instructions, model=first.generation_model, **first.generation_params)
        return answered.select(
            F.expr("uuid()").alias("response_id"), "query_id", "query_text", "cell_id", F.col("chunk_ids").alias("retrieved_chunk_ids"), X.plain_context(F.col("texts")).alias("retrieved_context"),
            "response_text", F.lit(first.generation_model or self.generator.model_name).alias("model_name"), F.lit(self.embedder.model_name).alias("embedding_model_name"), F.current_timestamp().alias("timestamp"), "metadata", *fields,
        )


def with_cell_id(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("cell_id", cell_id(df, fields))
