"""Documents to chunks: cleaning, overlapping character chunks, custom chunkers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions import text as X


def clean_documents(docs: DataFrame, clean_fn: Callable[[Column], Column] | Callable[[str], str] | None = None, preserve_raw: bool = False, python: bool = False, text_col: str = "text") -> DataFrame:
    """docs with text cleaned. preserve_raw keeps the first original in raw. clean_fn maps Columns, or, with python, strings."""
    if preserve_raw:
        old = F.col("raw") if "raw" in docs.columns else F.lit(None).cast("string")
        docs = docs.withColumn("raw", F.when(F.coalesce(old, F.lit("")) == "", F.col(text_col)).otherwise(old))
    if python and clean_fn:
        fn = clean_fn

        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return docs.withColumn(text_col, run(F.col(text_col)))
    return docs.withColumn(text_col, (clean_fn or X.clean)(F.col(text_col)))


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")


def chunk_count(text: Column, size: int, overlap: int) -> Column:
    """Chunks of a text; with a negative overlap, which leaves gaps, those that begin inside it."""
    n, stride = F.length(text), size - overlap
    more = F.ceil((n - size) / F.lit(stride)) + 1
    if overlap < 0:
        more = F.least(more, F.ceil(n / F.lit(stride)))
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(more).cast("int")


def chunk_texts(text: Column, size: int = 750, overlap: int = 100) -> Column:
    """Array of a text's chunks, in order: pieces of size characters, each starting size - overlap after the last."""
    check_sizes(size, overlap)
    stride = size - overlap
    n = chunk_count(text, size, overlap)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunks(docs: DataFrame, size: int = 750, overlap: int = 100, id_col: str = "document_id", text_col: str = "text", meta: list[str] | None = None) -> DataFrame:
    """One row for each chunk: chunk_id, document_id, text, chunk_index, start_char, end_char, metadata columns."""
    meta = meta if meta is not None else [c for c in docs.columns if c not in (id_col, text_col, "raw", "source_path")]
    pieces = docs.select(F.col(id_col), *meta, F.posexplode(chunk_texts(F.col(text_col), size, overlap)).alias("chunk_index", "text"))
    start = F.col("chunk_index") * (size - overlap)
    return pieces.select(X.chunk_id(F.col(id_col), F.col("chunk_index"), F.col("text")).alias("chunk_id"), id_col, "text", "chunk_index", start.alias("start_char"), (start + F.length("text")).alias("end_char"), *meta)


def sentences(text: Column) -> Column:
    """Array of sentences: a break follows . ! or ? and white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + X.UNIT)
    return F.filter(F.split(marked, X.UNIT), lambda x: x != "")


def custom_chunks(docs: DataFrame, chunk_fn: Callable[[str], list[str]] | Callable[[Column], Column], overlap: int = 100, python: bool = True, id_col: str = "document_id", text_col: str = "text", meta: list[str] | None = None) -> DataFrame:
    """chunks() with a chunker of one's own, a function of strings (Arrow batches) or, without python, of Columns.

    start_char is where the piece is found at or after the last piece's end less overlap, never below 0; where it
    isn't found, that origin itself.
    """
    meta = meta if meta is not None else [c for c in docs.columns if c not in (id_col, text_col, "raw", "source_path")]
    if python:
        fn = chunk_fn

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: list(fn(t)) if t else [])

        made = run(F.col(text_col))
    else:
        made = chunk_fn(F.col(text_col))

    @F.pandas_udf("array<int>")
    def origins(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        """Where the pieces of each text begin: found from the place before, not counted from the text's begin each time."""

        def places(whole: str, parts: list[str]) -> list[int]:
            out, upto = [], 0
            for piece in parts:
                origin = max(upto - overlap, 0)
                found = whole.find(piece or "", origin)
                out.append(origin if found < 0 else found)
                upto = out[-1] + len(piece or "")
            return out

        return pd.Series([None if t is None or p is None else places(t, p) for t, p in zip(texts, pieces)], dtype=object)

    listed = docs.select(F.col(id_col), *meta, F.col(text_col).alias("mq_whole"), made.alias("mq_pieces"))
    placed = listed.withColumn("mq_at", origins("mq_whole", "mq_pieces"))
    # an array of its own: a query that doesn't ask for places doesn't look for them
    rows = placed.select(id_col, *meta, "mq_at", F.posexplode("mq_pieces").alias("chunk_index", "mq_text"))
    text, start = F.col("mq_text"), F.get("mq_at", F.col("chunk_index"))
    return rows.select(X.chunk_id(F.col(id_col), F.col("chunk_index"), text).alias("chunk_id"), id_col, text.alias("text"), "chunk_index", start.alias("start_char"), (start + F.length(text)).alias("end_char"), *meta)


def duplicate_ids(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return df.groupBy(id_col).count().where("count > 1").select(id_col).orderBy(id_col)
