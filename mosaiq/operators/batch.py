"""Batch embedding: requests out, results in, state as an append-only event log."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions.text import normal_model
from mosaiq.operators.checkpoint import exists
from mosaiq.operators.models import passing, with_retries
from mosaiq.operators.store import ChunkStore
from mosaiq.session import written

WAVE_EVENTS, WAVE_SECONDS = 1000, 5  # events are logged together, as many and as long as this
INGEST_SECONDS = 60  # batches that came in so long are ingested together
TERMINAL = ("completed", "failed", "cancelled", "expired")
INGESTIBLE = ("completed", "cancelled", "expired")
EVENT = "batch_id string, provider string, model string, status string, input_file_id string, output_file_id string, error_file_id string, jsonl_path string, created_at bigint, updated_at bigint, ingested_at bigint, seq bigint"
OUTPUT = "custom_id string, response struct<status_code:int, body:struct<data:array<struct<embedding:array<double>, index:int>>>>"


def ascii_json(c: Column) -> Column:
    """JSON text with every character beyond ASCII as \\u escapes, pairs of them beyond the BMP."""
    def escape(run: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(run.rlike(r"^[\x00-\x7f]"), run).otherwise(units)

    plain = ~c.rlike(r"[^\x00-\x7f]")  # runs, not characters: most of them are long
    return F.when(plain, c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), F.lit(0)), escape), ""))


def request_lines(chunks: DataFrame, model: str, extra: dict[str, Any] | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(custom_id, value): one request in JSON, ASCII only, for each chunk."""
    body = [F.lit(model).alias("model"), F.col(text_col).alias("input"), *[F.lit(v).alias(k) for k, v in (extra or {}).items() if k not in ("model", "input")]]
    line = F.struct(F.col(id_col).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), F.struct(*body).alias("body"))
    return chunks.select(F.col(id_col).cast("string").alias("custom_id"), ascii_json(F.to_json(line, {"ignoreNullFields": "false"})).alias("value"))


def numbered(rows: DataFrame, order: list[str], col: str) -> DataFrame:
    """rows with col, their number from 0 in the order given, written. Each task counts its range; only the ranges' sizes,
    one row each, are added up in one task."""
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mq_i", F.monotonically_increasing_id()))
    part = F.shiftright("mq_i", 33)
    sizes = sorted_.groupBy(part.alias("mq_part")).agg(F.count(F.lit(1)).alias("mq_n"))
    before = F.coalesce(F.sum("mq_n").over(Window.orderBy("mq_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("mq_part", before.alias("mq_before")))
    joined = sorted_.withColumn("mq_part", part).join(starts, "mq_part")
    return joined.withColumn(col, F.col("mq_before") + F.col("mq_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("mq_i", "mq_part", "mq_before")


def assign_files(lines: DataFrame, order: list[str], max_lines: int, max_bytes: int | None = None, bytes_col: str | None = None, ranges: bool = False) -> DataFrame:
    """lines with file_no. Lines alone: the ordinal over max_lines. With a byte cap, greedily: a file is closed when
    it has max_lines or the next line would pass max_bytes, also if it is empty, so numbers can be skipped.

    The greedy rule depends on all lines before, so it is one ordered fold; only order and size go through it. ranges:
    each task folds a range of the order by itself and begins with a new file, which large tables need; there are as
    many files more, at most, as ranges.
    """
    if max_bytes is not None and not ranges:
        most = lines.agg(F.max(F.col(bytes_col).cast("bigint"))).first()[0] or 0
        max_bytes = None if max_lines * most <= max_bytes else max_bytes  # no file can reach the cap
    if max_bytes is None:
        return numbered(lines, order, "mq_ordinal").withColumn("file_no", F.floor(F.col("mq_ordinal") / max_lines).cast("int")).drop("mq_ordinal")
    sizes = lines.select(*order, F.col(bytes_col).cast("bigint").alias("mq_bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema if f.name != "mq_bytes") + ", mq_range int, mq_file int"

    def fold(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        used = count = number = 0
        for batch in batches:
            out = []
            for n in batch.column("mq_bytes").to_pylist():
                if count >= max_lines or used + n > max_bytes:
                    number, used, count = number + 1, 0, 0
                used, count = used + n, count + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array([task] * len(out), pa.int32()), pa.array(out, pa.int32())], [*order, "mq_range", "mq_file"])

    spread = sizes.repartitionByRange(*order) if ranges else written(sizes).coalesce(1)  # sizes are made in as many tasks as there are
    folded = written(spread.sortWithinPartitions(*order).mapInArrow(fold, schema))
    if not ranges:
        return lines.join(folded.select(*order, F.col("mq_file").alias("file_no")), order)
    most = folded.groupBy("mq_range").agg((F.max("mq_file") + 1).alias("mq_n"))
    before = F.coalesce(F.sum("mq_n").over(Window.orderBy("mq_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = most.select("mq_range", before.alias("mq_before"))
    return lines.join(folded.join(starts, "mq_range").select(*order, (F.col("mq_file") + F.col("mq_before")).cast("int").alias("file_no")), order)


def unique_in_file(lines: DataFrame, order: list[str], id_col: str = "custom_id") -> DataFrame:
    """lines with file_no, the first of each id in each file."""
    w = Window.partitionBy("file_no", id_col).orderBy(*order)
    return lines.withColumn("mq_n", F.row_number().over(w)).where("mq_n = 1").drop("mq_n")


def write_request_files(lines: DataFrame, path: str, order: list[str]) -> None:
    """One folder file_no=n for each request file, its lines in order."""
    lines.repartition("file_no").sortWithinPartitions("file_no", *order).select("file_no", "value").write.mode("overwrite").partitionBy("file_no").text(path)


def parse_output(lines: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(custom_id, vector) of the lines with status 200 and a vector, after columns to keep."""
    parsed = lines.select(*(keep or []), F.from_json(col, OUTPUT).alias("o"))
    vector = F.get(F.col("o.response.body.data"), F.lit(0))["embedding"]
    return parsed.where(F.col("o.response.status_code") == 200).select(*(keep or []), F.col("o.custom_id").alias("custom_id"), vector.alias("vector")).where("custom_id is not null and size(vector) > 0")


def ingestible(output: DataFrame, registry: DataFrame, store_ids: DataFrame) -> DataFrame:
    """Registry rows with vectors that the store doesn't have yet."""
    found = registry.join(output.withColumnRenamed("custom_id", "chunk_id").dropDuplicates(["chunk_id"]), "chunk_id")
    return found.join(store_ids.select("chunk_id"), "chunk_id", "left_anti")


def ingest_counts(output: DataFrame, registry: DataFrame, store_ids: DataFrame) -> DataFrame:
    """(added, skipped): vectors whose chunk is registered and new to the store; all others."""
    ids = output.select(F.col("custom_id").alias("chunk_id"))
    flagged = ids.join(registry.select("chunk_id", F.lit(1).alias("r")).distinct(), "chunk_id", "left").join(store_ids.select("chunk_id", F.lit(1).alias("s")).distinct(), "chunk_id", "left")
    new = F.col("r").isNotNull() & F.col("s").isNull()
    return flagged.agg(F.count_if(new).alias("added"), F.count_if(~new).alias("skipped"))


def latest(events: DataFrame, key: str = "batch_id", by: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """The latest event of each key. One partial aggregation, no sort."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])


def pending(candidates: DataFrame, events: DataFrame, key: str = "batch_id") -> DataFrame:
    """Candidates with no event, or whose latest status isn't final, or is ingestible and not ingested."""
    last = latest(events).select(key, "status", "ingested_at")
    open_ = F.col("status").isNull() | ~F.col("status").isin(*TERMINAL) | F.col("status").isin(*INGESTIBLE) & F.col("ingested_at").isNull()
    return candidates.select(key).distinct().join(last, key, "left").where(open_).select(key)


def queue(chunks: DataFrame, ids: DataFrame, order: list[str], limit: int | None, id_col: str = "chunk_id") -> DataFrame:
    new = chunks.join(ids.select(id_col), id_col, "left_anti").orderBy(*order)
    return new.limit(limit) if limit is not None else new


def plain_path(path: str) -> str:
    """A path as Hadoop's Path spells it, whose URI may have more slashes."""
    return re.sub("^file:/+", "file:/", path)


class BatchClient(Protocol):
    """A client may also have download_many(file_ids, to) -> paths, in their order, for providers that give many at once."""

    def upload(self, path: str) -> str: ...
    def create(self, file_id: str, window: str) -> dict[str, Any]: ...
    def retrieve(self, batch_id: str) -> dict[str, Any]: ...
    def download(self, file_id: str, to: str) -> str: ...


@dataclass
class BatchState:
    root: str
    model: str
    provider: str = "openai"
    completion_window: str = "24h"
    max_lines: int = 5000
    max_bytes: int = 20 << 20
    poll_seconds: float = 20
    download_retries: int = 5
    extra_body: dict[str, Any] = field(default_factory=dict)
    ranges: bool = False  # fold request files range by range

    def path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"

    def to_json(self) -> str:
        """Without fields whose names speak of keys."""
        return json.dumps({k: v for k, v in vars(self).items() if "key" not in k}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> BatchState:
        told = json.loads(text)
        known = {f for f in cls.__dataclass_fields__ if f in told}
        return cls(**{f: told[f] for f in known})


@dataclass
class IngestionResult:
    batch_id: str
    records_added: int
    records_skipped: int


class DownloadError(RuntimeError):
    pass


class BatchManager:
    """prepare -> submit -> poll. State is the registry and the event log, both Parquet under root, so another
    process can go on from the same BatchState."""

    def __init__(self, spark: SparkSession, state: BatchState, store: ChunkStore, client: BatchClient | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        self.spark, self.state, self.store, self.client, self.sleep, self.now = spark, state, store, client, sleep, now
        self._seq = 0

    @classmethod
    def from_state(cls, spark: SparkSession, root: str, client: BatchClient | None = None, store: ChunkStore | None = None, **options: Any) -> BatchManager:
        """The manager of a root that another one has prepared, by the settings that were saved there."""
        rows = spark.read.text(f"{root.rstrip('/')}/state").orderBy("value").collect()
        state = BatchState.from_json(rows[0][0])
        state.root = root
        return cls(spark, state, store or ChunkStore(spark, state.path("store")), client, **options)

    def save_state(self) -> None:
        self.spark.createDataFrame([(self.state.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(self.state.path("state"))

    def registry(self) -> DataFrame | None:
        path = self.state.path("registry")
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def events(self) -> DataFrame:
        path = self.state.path("events")
        return self.spark.read.schema(EVENT).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], EVENT)

    def _log(self, events: list[dict[str, Any]]) -> None:
        """Add events to the log, in one write."""
        if not events:
            return
        if not self._seq:
            self._seq = self.events().agg(F.max("seq")).first()[0] or 0
        names, rows = [x.split()[0] for x in EVENT.split(", ")], []
        for event in events:
            self._seq += 1
            row = {"provider": self.state.provider, "model": self.state.model, "updated_at": int(self.now()), "seq": self._seq, **event}
            rows.append(tuple(row.get(n) for n in names))
        self.spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(self.state.path("events"))

    def prepare(self, chunks: DataFrame, order: list[str], skip_existing: bool = True, queue_limit: int | None = None, register_all: bool = False) -> int:
        """Write request files for chunks that are not in the store; the number of requests. order names columns of chunks."""
        self.save_state()
        rows = chunks
        if skip_existing and self.store.exists():
            rows = rows.join(self.store.ids(), "chunk_id", "left_anti")
        rows = rows.dropDuplicates(["chunk_id"])
        queued = written(rows.orderBy(*order).limit(queue_limit) if queue_limit is not None else rows)
        known = self.registry()
        add = chunks.dropDuplicates(["chunk_id"]) if register_all else queued
        new = add if known is None else add.join(known.select("chunk_id"), "chunk_id", "left_anti")
        new.withColumn("created_at", F.lit(int(self.now())).cast("bigint")).write.mode("append").parquet(self.state.path("registry"))
        lines = request_lines(queued, normal_model(self.state.model, self.state.provider), self.state.extra_body)
        lines = lines.join(queued.select(F.col("chunk_id").cast("string").alias("custom_id"), *[c for c in order if c != "chunk_id"]), "custom_id")
        keys = [c if c != "chunk_id" else "custom_id" for c in order]
        filed = assign_files(lines.withColumn("mq_size", F.octet_length("value") + 1), keys, self.state.max_lines, self.state.max_bytes, "mq_size", self.state.ranges)
        filed = written(filed)
        write_request_files(filed, self.state.path("requests"), keys)
        return filed.count()

    def request_files(self) -> list[str]:
        path = self.state.path("requests")
        if not exists(self.spark, path):
            return []
        found = [plain_path(unquote(f)) for f in self.spark.read.text(path).inputFiles()]
        files = [(int(m[1]), f) for f in found if (m := re.search(r"/file_no=(\d+)/part-[^/]*$", f))]
        return [p for _, p in sorted(files)]

    def submit(self) -> list[str]:
        """Upload the request files that no batch was made of yet and create their batches. Batches are logged together,
        a few seconds' worth at most; also those made before an error."""
        out, sent = [], {r[0] for r in self.events().select("jsonl_path").distinct().collect()}
        made: list[dict[str, Any]] = []
        began = time.monotonic()
        try:
            for path in self.request_files():
                if path in sent:
                    continue
                file_id = self.client.upload(path)
                info = self.client.create(file_id, self.state.completion_window)
                made.append(dict(batch_id=info["id"], status=info.get("status"), input_file_id=file_id, jsonl_path=path, created_at=int(self.now()), updated_at=int(self.now())))
                out.append(info["id"])
                if len(made) >= WAVE_EVENTS or time.monotonic() - began > WAVE_SECONDS:
                    now, made = made, []
                    self._log(now)
                    began = time.monotonic()
        finally:
            self._log(made)
        return out

    def poll(self, window_seconds: float | None = None, rounds: int | None = None, continue_on_download_error: bool = False) -> list[IngestionResult]:
        """Until nothing is pending: ask for each pending batch, ingest what has an output file. A batch older than
        the window is left alone. Sleeps when a round brought nothing. What came in within a minute is ingested together,
        so a round's work doesn't grow with the number of its batches, only with what they hold."""
        results: list[IngestionResult] = []
        left: set[str] = set()
        while rounds is None or rounds > 0:
            rounds = None if rounds is None else rounds - 1
            events = self.events()
            last = {r["batch_id"]: r for r in latest(events).collect()}
            todo = [r[0] for r in pending(events.select("batch_id"), events).collect() if r[0] not in left]
            if not todo:
                break
            progress = False
            asked: list[dict[str, Any]] = []
            began = time.monotonic()
            try:
                for batch in sorted(todo):
                    old = last[batch]
                    if window_seconds is not None and old["created_at"] is not None and self.now() > old["created_at"] + window_seconds:
                        left.add(batch)
                        continue
                    info = self.client.retrieve(batch)
                    asked.append(dict(batch_id=batch, status=info.get("status"), input_file_id=old["input_file_id"], output_file_id=info.get("output_file_id"), error_file_id=info.get("error_file_id"), jsonl_path=old["jsonl_path"], created_at=old["created_at"], updated_at=int(self.now())))
                    progress = progress or info.get("status") in TERMINAL and info.get("status") not in INGESTIBLE
                    if time.monotonic() - began > INGEST_SECONDS:
                        now, asked = asked, []
                        progress = self._take(now, results, left, continue_on_download_error) or progress
                        began = time.monotonic()
            finally:
                progress = self._take(asked, results, left, continue_on_download_error) or progress
            if not progress:
                self.sleep(self.state.poll_seconds)
        return results

    def _take(self, asked: list[dict[str, Any]], results: list[IngestionResult], left: set[str], continue_on_download_error: bool) -> bool:
        """Log what batches were found to be, and ingest those that have an output file; whether any has."""
        self._log(asked)
        ready = [e for e in asked if e["status"] in INGESTIBLE and e["output_file_id"]]
        came: list[tuple[dict[str, Any], str]] = []
        failed: Exception | None = None
        try:
            many = getattr(self.client, "download_many", None)
            paths = many([e["output_file_id"] for e in ready], self.state.path("outputs")) if many and ready else []
        except Exception:  # one by one, then
            paths = []
        if len(paths) != len(ready):
            paths = []
        for n, e in enumerate(ready):
            try:
                path = paths[n] if paths else with_retries(lambda i=e: self.client.download(i["output_file_id"], self.state.path("outputs")), self.state.download_retries, 5, 60, self.sleep, passing)
            except Exception as error:
                if not continue_on_download_error:
                    failed = error
                    break
                left.add(e["batch_id"])
                continue
            came.append((e, path))
        self._ingest_logged(came, results)
        if failed is not None:
            raise DownloadError(str(failed)) from failed
        return bool(came)

    def _ingest_logged(self, came: list[tuple[dict[str, Any], str]], results: list[IngestionResult]) -> None:
        """Ingest batches together and log it; where one of them can't be, those before it are."""
        if not came:
            return
        try:
            got = self.ingest_all([(e["batch_id"], path) for e, path in came])
        except Exception:
            if len(came) == 1:
                raise
            half = len(came) // 2
            self._ingest_logged(came[:half], results)
            self._ingest_logged(came[half:], results)
            return
        self._log([{**e, "updated_at": int(self.now()), "ingested_at": int(self.now())} for e, _ in came])
        results += got

    def _outputs(self, paths: list[str]) -> DataFrame:
        """(mq_n, custom_id, vector) of output files, or folders of them; mq_n: which of paths."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        fs = hadoop(paths[0]).getFileSystem(conf)
        full = [(plain_path(fs.makeQualified(hadoop(p)).toString()), n) for n, p in enumerate(paths)]
        file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
        lines = self.spark.read.text(list(dict.fromkeys(paths))).select("value", F.explode(F.array(file, F.regexp_replace(file, "/[^/]*$", ""))).alias("mq_path"))
        told = lines.join(F.broadcast(self.spark.createDataFrame(full, "mq_path string, mq_n int")), "mq_path")
        return parse_output(told, keep=["mq_n"])

    def ingest(self, batch_id: str, path: str) -> IngestionResult:
        return self.ingest_all([(batch_id, path)])[0]

    def ingest_all(self, batches: list[tuple[str, str]]) -> list[IngestionResult]:
        """Add the vectors of (batch, path of its output) to the store at once. A chunk that several have counts for the first."""
        output, registry = written(self._outputs([p for _, p in batches])), self.registry()
        total = dict(output.groupBy("mq_n").count().collect())
        known = dict(output.join(registry, output["custom_id"] == registry["chunk_id"], "left_semi").groupBy("mq_n").count().collect()) if registry is not None else {}
        for n, (batch_id, _) in enumerate(batches):
            if registry is None or total.get(n) and not known.get(n):
                raise RuntimeError(f"no vector of batch {batch_id} is registered")
        first = output.groupBy("custom_id").agg(F.min_by("vector", "mq_n").alias("vector"), F.min("mq_n").alias("mq_n"))
        rows = written(ingestible(first, registry, self.store.ids() if self.store.exists() else registry.select("chunk_id").limit(0)))
        added = dict(rows.groupBy("mq_n").count().collect())
        if added:
            core = {"chunk_id", "document_id", "text", "chunk_index", "start_char", "end_char", "vector", "created_at", "mq_n"}
            meta = [c for c in rows.columns if c not in core]
            self.store.add(rows.drop("created_at", "mq_n").withColumn("embedding_model", F.lit(self.state.model)), meta, ["document_id", "chunk_index"])
        return [IngestionResult(b, added.get(n, 0), total.get(n, 0) - added.get(n, 0)) for n, (b, _) in enumerate(batches)]
