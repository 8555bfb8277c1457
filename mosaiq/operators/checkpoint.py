"""Checkpoints of responses: an append-only folder of JSON lines, read back for resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "response_id string, query_id string, query_text string, cell_id string, cell_filter string, retrieved_chunk_ids array<string>, retrieved_context string, response_text string, model_name string, embedding_model_name string, timestamp string, metadata string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def iso(column: str = "timestamp"):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def records(responses: DataFrame) -> DataFrame:
    """Responses in the checkpoint's columns: the cell's fields as one JSON object, the time in ISO form."""
    core = {"response_id", "query_id", "query_text", "cell_id", "retrieved_chunk_ids", "retrieved_context", "response_text", "model_name", "embedding_model_name", "timestamp", "metadata"}
    fields = sorted(c for c in responses.columns if c not in core)
    cell = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
    return responses.select("response_id", "query_id", "query_text", "cell_id", cell.alias("cell_filter"), "retrieved_chunk_ids", "retrieved_context", "response_text", "model_name", "embedding_model_name", iso().alias("timestamp"), "metadata")


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    """Checkpointed responses; none if there is no such folder. Blank lines don't count."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def processed_keys(responses: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Distinct (query_id, cell_id) of responses, missing ones as empty text; with retry_errors without failed ones."""
    rows = responses
    if retry_errors:
        rows = rows.where(F.get_json_object("metadata", "$.error").isNull())
    return rows.select(F.coalesce("query_id", F.lit("")).alias("query_id"), F.coalesce("cell_id", F.lit("")).alias("cell_id")).distinct()


class Checkpoint:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def processed(self, retry_errors: bool = False) -> DataFrame:
        return processed_keys(load_responses(self.spark, self.path), retry_errors)

    def unprocessed(self, frame: DataFrame) -> DataFrame:
        return frame.join(self.processed(), ["query_id", "cell_id"], "left_anti")

    def append(self, responses: DataFrame) -> DataFrame:
        """Write responses to the end of the checkpoint and give them back as written: models are called once."""
        from mosaiq.session import written

        fixed = written(responses)
        records(fixed).write.mode("append").json(self.path)
        return fixed
