"""Filtered top-k search, over all chunks or in every cell at once. Filters apply before scores, always."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.filters import compile_filter
from mosaiq.functions.vectors import cosine_to, l2_score_to
from mosaiq.operators.cells import present

SCORES = {"cosine": cosine_to, "l2": l2_score_to}


def score_to(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    return SCORES[metric](vector, query)


def similarity_search(store: DataFrame, query: list[float], k: int = 5, spec: dict[str, Any] | None = None, metric: str = "cosine", order: list[str] | None = None, vector_col: str = "vector", min_score: float | None = None) -> DataFrame:
    """The k best of the rows that pass the filter, with score; ties in the order of the columns given.

    k below 1 gives no rows. One TakeOrderedAndProject: each task keeps k rows, no shuffle of the store.
    """
    if k <= 0:
        return store.withColumn("score", F.lit(0.0)).limit(0)
    rows = store.where(compile_filter(store, spec)).withColumn("score", score_to(F.col(vector_col), query, metric))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), *(order or ["chunk_id"])).limit(k)


def ranked(rows: DataFrame, by: list[str], k: int, order: list[str]) -> DataFrame:
    """The k best rows by score in each group, with rank; WindowGroupLimit cuts before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def per_cell(store: DataFrame, fields: list[str], queries: list[dict[str, Any]], base: dict[str, Any] | None = None, cells: DataFrame | None = None, metric: str = "cosine", order: list[str] | None = None, vector_col: str = "vector", min_score: float | None = None) -> DataFrame:
    """(query_id, *fields, rank, score, store columns but the vector): top k of each query in each cell, in one plan.

    queries: query_id, vector and k of each. cells: restrict to these cells (an equi-join Spark sizes itself);
    None: all cells of the store, which takes no join.
    """
    rows = store.where(present(fields) & compile_filter(store, base))
    if cells is not None:
        rows = rows.join(cells.select(*fields).distinct(), fields, "left_semi")
    if not queries:
        raise ValueError("queries must be given")
    scored = F.array(*[F.struct(F.lit(q["query_id"]).alias("query_id"), F.lit(int(q["k"])).alias("mq_k"), score_to(F.col(vector_col), q["vector"], metric).alias("score")) for q in queries])
    keep = [c for c in store.columns if c != vector_col]
    flat = rows.select(*keep, F.inline(scored)) if len(queries) > 1 else rows.select(*keep, scored[0]["query_id"].alias("query_id"), scored[0]["mq_k"].alias("mq_k"), scored[0]["score"].alias("score"))
    if min_score is not None:
        flat = flat.where(F.col("score") >= min_score)
    top = ranked(flat, ["query_id", *fields], max(int(q["k"]) for q in queries), order or ["chunk_id"])
    return top.where(F.col("rank") <= F.col("mq_k")).drop("mq_k")


class Retriever:
    """Text queries against a store: embeds on the driver, then searches."""

    def __init__(self, store: DataFrame, embed_query, default_k: int = 5, metric: str = "cosine", order: list[str] | None = None):
        self.store, self.embed_query, self.default_k, self.metric, self.order = store, embed_query, default_k, metric, order

    def retrieve(self, query_text: str, cell_filter: dict[str, Any] | None = None, k: int | None = None) -> DataFrame:
        k = self.default_k if k is None else k
        if not query_text:
            raise ValueError("a question is needed")
        if k <= 0:
            raise ValueError("k must be positive")
        return similarity_search(self.store, self.embed_query(query_text), k, cell_filter, self.metric, self.order)
