"""Stores of chunks with vectors: Parquet batches that are only ever added to, and one in memory."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions.filters import compile_filter
from mosaiq.functions.vectors import checked
from mosaiq.operators import cells, retrieval
from mosaiq.session import written

RESERVED = ["chunk_id", "document_id", "text", "chunk_index", "start_char", "end_char", "embedding_model", "metadata_json", "vector", "seq"]


def index_rows(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """chunks with their vectors, joined one to one on chunk_id."""
    return chunks.join(embeddings.select("chunk_id", "vector", "embedding_model"), "chunk_id")


def align(new: DataFrame, old: DataFrame) -> DataFrame:
    """new in old's columns: columns that old lacks go (metadata_json still has them), those it has are null."""
    have = set(new.columns)
    return new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])


def skip_existing(chunks: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return chunks.join(ids.select(id_col), id_col, "left_anti")


def existing(chunks: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return ids.join(chunks.select(id_col), id_col, "left_semi").select(id_col).distinct()


class VectorStore(ABC):
    """What a store of chunks can do; rows are DataFrames with chunk_id, text, vector, seq and metadata columns."""

    @abstractmethod
    def read(self) -> DataFrame:
        """All chunks; seq is a chunk's place."""

    @abstractmethod
    def add(self, chunks: DataFrame, meta: list[str], order: list[str] | None = None, append_duplicates: bool = False) -> None:
        """Add chunks with vector and embedding_model. A chunk whose id is there takes that one's place."""

    def search(self, query: list[float], k: int = 5, spec: dict[str, Any] | None = None, metric: str = "cosine", min_score: float | None = None) -> DataFrame:
        return retrieval.similarity_search(self.read(), query, k, spec, metric, ["seq"], min_score=min_score)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.read().where(F.col("chunk_id") == chunk_id).limit(1)

    def chunks_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def scan(self, spec: dict[str, Any] | None = None) -> DataFrame:
        df = self.read()
        return df.where(compile_filter(df, spec))

    def list_metadata_values(self, fields: list[str]) -> DataFrame:
        rows = self.read()
        return cells.list_metadata_values(rows, fields, "metadata_json" if "metadata_json" in rows.columns else None)

    def ids(self) -> DataFrame:
        return self.read().select("chunk_id").distinct()

    def count(self) -> int:
        return self.read().count()

    def persist(self) -> None:
        """Nothing is left to do: what was added is kept when add() returns."""


CORE = "chunk_id string, document_id string, text string, chunk_index int, start_char int, end_char int, embedding_model string, metadata_json string, vector array<float>, seq bigint"


class ChunkStore(VectorStore):
    """A folder of Parquet batches. Vectors are stored as floats.

    add() writes one batch under rows/batch=n and, where it replaces chunks, their ids under replaced/batch=n; the batch
    is there once the file batches/n exists, which is written last. So nothing that is stored is written anew, what an
    add costs follows what it adds, and one that breaks off leaves nothing behind that is read. A chunk is read from
    the last batch that has it. compact() folds all batches into one.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None):
        if not path:
            raise ValueError("a store needs a path")
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by or []

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: Any):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def batches(self) -> list[int]:
        """Numbers of the batches that are there, none before the last compaction."""
        fs = self._files()
        if not fs.exists(self._path("batches")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path("batches"))]
        numbers = sorted(int(n.removesuffix(".base")) for n in names if n.removesuffix(".base").isdigit())
        bases = [int(n.removesuffix(".base")) for n in names if n.endswith(".base")]
        return [n for n in numbers if n >= max(bases, default=0)]

    def exists(self) -> bool:
        return bool(self.batches())

    def read(self) -> DataFrame:
        batches = self.batches()
        if not batches:
            return self.spark.createDataFrame([], CORE)
        rows = self._table("rows", batches)
        fs = self._files()
        replaced = [n for n in batches if fs.exists(self._path("replaced", f"batch={n}"))]
        if replaced:
            gone = self.spark.read.option("basePath", f"{self.path}/replaced").parquet(*[f"{self.path}/replaced/batch={n}" for n in replaced])
            gone = gone.groupBy("chunk_id").agg(F.max("batch").alias("mq_since"))
            rows = rows.join(gone, "chunk_id", "left").where(F.col("mq_since").isNull() | (F.col("batch") >= F.col("mq_since"))).select(*rows.columns)
        return rows.drop("batch")

    def _table(self, part: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{part}/batch={n}" for n in batches]
        schema = self.spark.read.option("basePath", f"{self.path}/{part}").parquet(paths[0]).schema  # later batches take the first one's columns
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths)

    def add(self, chunks: DataFrame, meta: list[str], order: list[str] | None = None, append_duplicates: bool = False) -> None:
        """Metadata may not take a reserved name. The model that made the vectors runs once: chunks are written first."""
        clash = [m for m in meta if m in RESERVED]
        if clash:
            raise ValueError(f"metadata takes reserved names: {', '.join(clash)}")
        rows = chunks.withColumns({"metadata_json": cells.metadata_json(chunks, meta), "vector": checked(F.col("vector")).cast("array<float>")})
        if not append_duplicates:
            rows = rows.dropDuplicates(["chunk_id"])
        rows = written(rows)
        dims = rows.agg(F.count_distinct(F.size("vector")).alias("n"), F.min(F.size("vector")).alias("d"), F.count(F.when(F.col("vector").isNull(), 1)).alias("none")).first()
        if dims["n"] > 1 or dims["none"] or (dims["n"] and dims["d"] < 1):
            raise ValueError("vectors must be there and have one positive size")
        batches, old = self.batches(), self.read()
        number = (batches or [-1])[-1] + 1
        self._files().delete(self._path("replaced", f"batch={number}"), True)  # an add that broke off may have left it
        # places follow each partition's rows; gaps between partitions don't matter, only the order does
        ordered = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order) if order else rows
        start = (old.agg(F.max("seq")).first()[0] or 0) + 1 if batches else 0
        core = ["chunk_id", "document_id", "text", "chunk_index", "start_char", "end_char", "embedding_model", "metadata_json", "vector", "seq"]
        new = ordered.withColumn("seq", F.monotonically_increasing_id() + F.lit(start)).select(*core, *sorted(meta))
        if batches:
            new = align(new, old)
            if not append_duplicates:
                kept = written(old.join(rows.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("seq").alias("mq_seq")))
                if not kept.isEmpty():
                    kept.select("chunk_id").write.mode("overwrite").parquet(f"{self.path}/replaced/batch={number}")
                    new = new.join(kept, "chunk_id", "left").withColumn("seq", F.coalesce("mq_seq", "seq")).select(*old.columns)
        self._write(new, number)
        self._files().create(self._path("batches", number), False).close()

    def _write(self, rows: DataFrame, number: int) -> None:
        w = rows.write.mode("overwrite")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(f"{self.path}/rows/batch={number}")

    def compact(self) -> None:
        """All batches as one; the ones before are deleted after it is there."""
        batches, fs = self.batches(), self._files()
        if len(batches) < 2:
            return
        number = batches[-1] + 1
        self._write(self.read(), number)
        fs.create(self._path("batches", f"{number}.base"), False).close()
        for n in batches:
            for part in (("rows", f"batch={n}"), ("replaced", f"batch={n}"), ("batches", n), ("batches", f"{n}.base")):
                fs.delete(self._path(*part), True)


class MemoryStore(VectorStore):
    """A store that lives in a DataFrame. The last of rows with one id counts, at the place of the first."""

    def __init__(self, rows: DataFrame | None = None):
        self.rows = rows

    def read(self) -> DataFrame:
        if self.rows is None:
            raise ValueError("nothing was added yet")
        return self.rows

    def add(self, chunks: DataFrame, meta: list[str] | None = None, order: list[str] | None = None, append_duplicates: bool = False) -> None:
        order = order or ["chunk_id"]
        chunks = written(chunks)
        start = 0 if self.rows is None else (self.rows.agg(F.max("seq")).first()[0] or 0) + 1
        new = chunks.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id() + F.lit(start))
        both = new if self.rows is None else self.rows.unionByName(new, allowMissingColumns=True)
        if not append_duplicates:
            w = Window.partitionBy("chunk_id")
            both = both.withColumns({"mq_first": F.min("seq").over(w), "mq_last": F.max("seq").over(w)}).where("seq = mq_last").withColumn("seq", F.col("mq_first")).drop("mq_first", "mq_last")
        self.rows = written(both)
