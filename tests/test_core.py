"""Parts of the engine beside the catalog: spellings, ids, retries, stores that break off, caches, resuming, entry."""

import json
import os
import random
import struct
import sys
import time
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq import config, session
from mosaiq.engine import Engine
from mosaiq.functions import filters, vectors
from mosaiq.functions import text as X
from mosaiq.operators import batch, cells, checkpoint, compare, export, models, retrieval, store
from mosaiq.sources import files

CHUNK = "chunk_id string, document_id string, text string, chunk_index int, start_char int, end_char int, team string"


def chunks(spark, ids, team="red"):
    return spark.createDataFrame([(f"c{i}", f"d{i}", f"text {i}", 0, 0, 6, team) for i in ids], CHUNK)


def test_numbers_are_spelled_as_python_does(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, 1.7976931348623157e308, 1e16, 1e-4, 1e-5, 123456789.125, 1e22, 9.5e-101, 2.5e100, 1.0, 1e7, float("nan"), float("inf"), float("-inf"), -3e-7]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [rng.uniform(-1e6, 1e6) for _ in range(100)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["s"] for r in rows.select("i", X.py_str(F.col("v"), T.DoubleType()).alias("s")).collect()}
    assert all(float(got[i]) == v or v != v for i, v in enumerate(values))
    assert all(("e" in got[i]) == ("e" in repr(v)) for i, v in enumerate(values))
    same = sum(got[i] == repr(v) for i, v in enumerate(values))
    assert same >= 0.97 * len(values)  # the JVM's shortest digits differ in a few
    assert all(got[i] == repr(v) for i, v in enumerate(values[:17]))
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[X.py_str(F.lit(x), T.BooleanType()) for x in (True, False)]))).collect()] == ["True", "False"]


def test_questions_that_are_asked_differently_have_their_own_ids():
    ask = [{}, {"additional_instructions": "short"}, {"generation_model": "m"}, {"generation_params": {"temperature": 1}}, {"generation_params": {"temperature": 2}}, {"retrieval_k": 3}]
    assert len({compare.QuerySpec("who?", ["team"], **a).query_id for a in ask}) == len(ask)
    assert compare.QuerySpec("a", ["b\x1fc"]).query_id != compare.QuerySpec("a", ["b", "c"]).query_id


class Refused(Exception):
    def __init__(self, status):
        self.response = SimpleNamespace(status_code=status)


@pytest.mark.parametrize("error, again, calls", [(Refused(401), models.may_pass, 1), (Refused(503), models.may_pass, 4), (Refused(429), models.passing, 4), (ValueError("odd"), models.passing, 1), (ValueError("gateway time-out"), models.passing, 4), (TimeoutError(), models.passing, 4), (ValueError("odd"), models.may_pass, 4)])
def test_only_errors_that_may_pass_are_tried_again(error, again, calls):
    made = []

    def call():
        made.append(1)
        raise error

    with pytest.raises(type(error)):
        models.with_retries(call, 3, sleep=lambda _: None, again=again)
    assert len(made) == calls


def test_a_store_asks_the_model_once_for_each_text(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def call(model, texts):
        seen.add(len(texts))
        return [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)]

    kept = store.ChunkStore(spark, str(tmp_path / "s"))
    kept.add(models.ProviderEmbedder(call, "m").embed(chunks(spark, range(200))), ["team"], ["chunk_id"])
    assert (seen.value, kept.count()) == (200, 200)


def test_a_store_replaces_in_place_and_an_add_that_breaks_off_leaves_nothing(spark, tmp_path):
    kept, model = store.ChunkStore(spark, str(tmp_path / "s"), ["team"]), models.MockEmbedder(4)
    assert kept.count() == 0 and not kept.exists()
    kept.add(model.embed(chunks(spark, range(10))), ["team"], ["chunk_id"])
    places = {r["chunk_id"]: r["seq"] for r in kept.read().collect()}
    kept.add(model.embed(chunks(spark, [3, 4, 11, 12], "blue")), ["team"], ["chunk_id"])
    rows = {r["chunk_id"]: r for r in kept.read().collect()}
    assert len(rows) == 12 and kept.count() == 12 and {i for i, r in rows.items() if r["team"] == "blue"} == {"c3", "c4", "c11", "c12"}
    assert all(rows[i]["seq"] == p for i, p in places.items()) and min(rows["c11"]["seq"], rows["c12"]["seq"]) > max(places.values())
    with pytest.raises(Exception):
        kept.add(chunks(spark, [1, 20]).withColumns({"vector": F.array(F.lit(float("nan"))), "embedding_model": F.lit("m")}), ["team"])
    chunks(spark, [1, 2]).select("chunk_id").write.parquet(f"{tmp_path}/s/replaced/batch=2")  # as an add leaves it that dies half-way
    assert kept.count() == 12
    kept.add(model.embed(chunks(spark, [1], "green")), ["team"], ["chunk_id"], append_duplicates=True)
    assert kept.count() == 13 and kept.ids().count() == 12
    before = sorted((r["chunk_id"], r["team"], r["seq"]) for r in kept.read().collect())
    kept.compact()
    assert kept.batches() == [3] and sorted((r["chunk_id"], r["team"], r["seq"]) for r in kept.read().collect()) == before
    kept.persist()


def test_stores_share_a_protocol(spark, tmp_path):
    rows, query = models.MockEmbedder(4).embed(chunks(spark, range(5)).unionByName(chunks(spark, range(5, 9), "blue"))), X.hash_vector_of("text 6", 4)
    for kept in (store.MemoryStore(), store.ChunkStore(spark, str(tmp_path / "s"))):
        kept.add(rows, ["team"], ["chunk_id"])
        assert isinstance(kept, store.VectorStore)
        assert [r["chunk_id"] for r in kept.search(query, 1, {"team": "blue"}).collect()] == ["c6"] and kept.search(query, 9, min_score=2.0).count() == 0
        assert kept.get_chunk("c7").first()["text"] == "text 7" and kept.chunks_by_ids(rows.where("chunk_index = 0").limit(3)).count() == 3
        assert {r["field"]: r["values"] for r in kept.list_metadata_values(["team"]).collect()} == {"team": ["blue", "red"]}
        assert kept.scan({"team": "red"}).count() == 5 and kept.ids().count() == kept.count() == 9


def test_a_run_that_breaks_off_has_lost_one_wave(spark, tmp_path):
    rows = models.MockEmbedder(4).embed(chunks(spark, range(6)).unionByName(chunks(spark, range(6, 9), "blue")).withColumn("day", F.col("chunk_id")))

    class Breaking(checkpoint.Checkpoint):
        appended = 0

        def append(self, responses):
            if Breaking.appended == 3:
                raise RuntimeError("power cut")
            Breaking.appended += 1
            return super().append(responses)

    runner, asked = compare.Runner(rows, models.MockEmbedder(4), models.MockGenerator(), order=["chunk_id"]), [compare.QuerySpec("who?", ["team", "day"])]
    with pytest.raises(RuntimeError):
        runner.run(asked, checkpoint=Breaking(spark, str(tmp_path / "ck")), waves=4)
    saved = checkpoint.load_responses(spark, str(tmp_path / "ck")).count()
    kept = checkpoint.Checkpoint(spark, str(tmp_path / "ck"))
    again = runner.run(asked, checkpoint=kept, resume=True).count()
    assert 0 < saved < 9 and saved + again == 9
    assert checkpoint.load_responses(spark, kept.path).select("cell_id").distinct().count() == 9
    with pytest.raises(ValueError):
        runner.run(asked * 2)


def test_last_line_of_a_cache_counts_and_retried_errors(spark, tmp_path):
    lines = spark.createDataFrame([("h", "m", [1.0], 1), ("h", "m", [2.0], 5), ("h", "n", [3.0], 9), ("g", "m", [4.0], 2)], "text_hash string, model string, vector array<double>, line_no int")
    assert {r["text_hash"]: r["vector"] for r in models.load_cache(lines, "m").collect()} == {"h": [2.0], "g": [4.0]}
    cache = models.EmbeddingCache(spark, str(tmp_path / "c"))
    assert cache.vectors("m").count() == 0
    told = spark.createDataFrame([("q", "c1", '{"error": "x"}'), ("q", "c2", ""), (None, "c3", None)], "query_id string, cell_id string, metadata string")
    assert checkpoint.processed_keys(told).count() == 3 and checkpoint.processed_keys(told, True).count() == 2


def test_configuration_drives_the_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mail me@x.org NOW\nsee www.x.org")
    (tmp_path / "in" / "b.txt").write_text("quiet text")
    (tmp_path / "in" / "c.csv").write_text("no text file")
    c = config.EngineConfig(ingestion=config.IngestionConfig(format="txt", directory_path=str(tmp_path / "in")), cleaning=config.CleaningConfig(strip_urls=True, strip_emails=True, lowercase=True), retrieval=config.RetrievalConfig(k=2, min_score=2.0), export=config.ExportConfig("json", str(tmp_path / "out"), False), embedding=config.EmbeddingConfig("own", str(tmp_path / "cache")))
    e = Engine.from_config(spark, c).clean().chunk().embed()
    assert [r["text"] for r in e.documents.orderBy("document_id").collect()] == ["mail now\nsee", "quiet text"]
    assert {r[0] for r in e.embedded.select("embedding_model").collect()} == {"own"} and e.embedder.cache.lines().count() == 2
    e.index(str(tmp_path / "store")).compare("what?", ["filename"]).export_responses().export_chunks()
    assert e.responses.count() == 2 and all(r["retrieved_chunk_ids"] == [] for r in e.responses.collect())  # no score is 2
    assert "retrieved_context" in spark.read.json(f"{tmp_path}/out/responses").columns and "text" not in spark.read.json(f"{tmp_path}/out/chunks").columns
    first = sorted(map(str, e.responses.collect()))
    assert first == sorted(map(str, e.responses.collect()))  # ids and times stay
    chat = models.ProviderGenerator(lambda model, messages, **_: messages[0]["content"], "m")
    c.generation.system_prompt = "Sing."
    assert {r["response_text"] for r in e.compare("what?", ["filename"], generator=chat).responses.collect()} == {"Sing."}


def test_sources_that_are_not_there_and_random_ids(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "no.csv"), "x")
    with pytest.raises(ValueError):
        files.ingest(spark, str(tmp_path), "doc")
    (tmp_path / "one+two.csv").write_text("body,n\n text ,1\n,2\n")
    with pytest.raises(NotADirectoryError):
        files.read_text_folder(spark, str(tmp_path / "one+two.csv"))
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "one+two.csv"), "text")
    named = files.read_csv(spark, str(tmp_path / "one+two.csv"), "body", ["n"]).collect()
    assert [tuple(r) for r in named] == [("one+two_0", "one+two.csv:row_0", "text", 1)]
    loose = files.read_csv(spark, str(tmp_path / "one+two.csv"), "body", auto_generate_ids=False)
    assert loose.collect() == loose.collect() and len(loose.first()["document_id"]) == 36
    assert files.preview(spark, str(tmp_path / "one+two.csv"), 1).count() == 1


def test_pdf_pages_that_fail_are_left_out(spark):
    def pages_of(data):
        if data == b"bad":
            raise ValueError
        def fail():
            raise ValueError
        return [lambda: "first", fail, lambda: " ", lambda: data.decode()]

    rows = spark.createDataFrame([("/a/x.pdf", b"last"), ("/a/y.pdf", b"bad")], "path string, content binary")
    got = files.pdf_documents(rows, pages_of).collect()
    assert [tuple(r) for r in got] == [("x", "/a/x.pdf", "first\n \nlast", 4, "x.pdf", "pdf")]


def test_requests_once_in_a_file_and_state_without_keys(spark):
    lines = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "b", 1)], "i int, custom_id string, file_no int")
    assert sorted(r["i"] for r in batch.unique_in_file(lines, ["i"]).collect()) == [1, 3, 4]
    state = batch.BatchState("/r", "m", max_lines=7, extra_body={"dimensions": 3})
    assert batch.BatchState.from_json(state.to_json()) == state and batch.BatchState.from_json('{"root": "/r", "model": "m", "later": 1}').max_lines == 5000
    numbered = batch.numbered(spark.range(1000).repartition(7).select((F.col("id") * 3).alias("k")), ["k"], "n").collect()
    assert sorted((r["n"], r["k"]) for r in numbered) == [(i, 3 * i) for i in range(1000)]


def test_small_parts(spark):
    one = spark.createDataFrame([(None, "t")], "document_id string, text string")
    from mosaiq.operators import chunking

    assert chunking.chunks(one).first()["chunk_id"] is not None
    assert len(filters.conditions([("a", "=", str(i)) for i in range(20)])["__clauses__"]) == 20
    rows = spark.createDataFrame([({"b": 1.0, "a": float("nan")}, b"\xc3\xa9", [float("inf"), 1.0])], "m map<string,double>, b binary, l array<double>")
    assert rows.select(cells.metadata_json(rows, ["m", "l", "b"])).first()[0] == '{"b":"é","l":[null,1.0],"m":{"a":null,"b":1.0}}'
    told = spark.createDataFrame([("x" * 200, "red")], "response_text string, team string")
    assert [tuple(r) for r in export.preview(told).collect()] == [("red", "x" * 137 + "...")]
    with pytest.raises(ValueError):
        retrieval.Retriever(one, lambda t: [1.0]).retrieve("")
    assert models.redacted({"api_key": "k", "max_tokens": 3, "deep": {"Authorization": "b", "x": 1}}) == {"api_key": "***", "max_tokens": 3, "deep": {"Authorization": "***", "x": 1}}


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        session.shared_folder(spark)


def test_spread_and_settled(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    table = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(table).rdd.getNumPartitions() == cores and session.spread(table.repartition(3 * cores)).rdd.getNumPartitions() == 3 * cores
    first = session.written(table)
    second = session.settled(first.where("id < 50"))
    assert second.count() == 50
    with pytest.raises(Exception):
        first.count()


def test_entry_keeps_its_queries_when_a_library_of_the_others_is_missing(monkeypatch):
    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("mosaiq.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    known = __spark_entry__.queries()
    assert len(known) > 80 and not any(n.startswith("op") or n == "pipeline" for n in known) and set(__spark_entry__.oracle_sql()) <= set(known)


class Provider:
    """A provider of batches in plain files that refuses some uploads."""

    def __init__(self, folder, refused=()):
        self.folder, self.refused, self.files = folder, refused, {}

    def upload(self, path):
        if len(self.files) in self.refused:
            raise RuntimeError("refused")
        self.files[f"f{len(self.files):03d}"] = path
        return f"f{len(self.files) - 1:03d}"

    def create(self, file_id, window):
        return {"id": f"b-{file_id}", "status": "in_progress"}

    def retrieve(self, batch_id):
        return {"id": batch_id, "status": "completed", "output_file_id": batch_id.removeprefix("b-")}

    def download(self, file_id, to):
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{file_id} 1.jsonl", "w") as f:
            for line in open(self.files[file_id].removeprefix("file:")):
                f.write(json.dumps({"custom_id": json.loads(line)["custom_id"], "response": {"status_code": 200, "body": {"data": [{"embedding": self.vector(file_id), "index": 0}]}}}) + "\n")
        return f"{self.folder}/{file_id} 1.jsonl"

    def vector(self, file_id):
        return [1.0, 2.0]


def prepared(spark, root, client, rows=60):
    first = batch.BatchManager(spark, batch.BatchState(root, "openai/e", max_lines=2), store.ChunkStore(spark, f"{root}/store"), client)
    assert first.prepare(chunks(spark, range(rows)).withColumn("document_id", F.lpad(F.substring("chunk_id", 2, 9), 3, "0")), ["document_id", "chunk_index"]) == rows
    return first


def jobs_of(spark, work):
    """What work() gives, and the number of Spark jobs that it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_batches_take_no_more_jobs_than_few(spark, tmp_path):
    jobs = []
    for n, rows in enumerate((6, 60)):
        manager = prepared(spark, str(tmp_path / f"r{n}"), Provider(str(tmp_path / f"out{n}")), rows)
        made, a = jobs_of(spark, manager.submit)
        got, b = jobs_of(spark, manager.poll)
        jobs.append(a + b)
        assert len(made) == len(got) == rows // 2 and {(r.records_added, r.records_skipped) for r in got} == {(2, 0)}
        assert manager.store.count() == rows and manager.events().count() == 3 * len(made) and manager.submit() == []
        assert manager.events().select("seq").distinct().count() == 3 * len(made)
    assert jobs[1] < 2 * jobs[0]


def test_batches_before_one_that_breaks_off_are_kept(spark, tmp_path):
    client = Provider(str(tmp_path / "out"), refused=(3,))
    manager = prepared(spark, str(tmp_path / "r"), client, 8)
    with pytest.raises(RuntimeError):
        manager.submit()
    client.refused = ()
    assert manager.events().count() == 3 and len(manager.submit()) == 1
    client.vector = lambda file_id: [1.0, 2.0] if file_id < "f002" else [float("nan"), 1.0]
    with pytest.raises(Exception):
        manager.poll()
    assert manager.store.count() == 4 and manager.events().where("ingested_at is not null").count() == 2
    client.vector = lambda file_id: [1.0, 2.0]
    assert [r.batch_id for r in manager.poll()] == ["b-f002", "b-f003"] and manager.store.count() == 8


def test_a_cap_of_bytes_that_no_file_can_reach_gives_the_same_files(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(10).alias("b"))
    want = batch.assign_files(rows, ["k"], 7, 69, "b").collect()  # one byte short: the fold, with files closed by lines or bytes
    assert max(r["file_no"] for r in want) == 16
    got = batch.assign_files(rows, ["k"], 7, 70, "b")
    assert sorted((r["k"], r["file_no"]) for r in got.collect()) == [(i, i // 7) for i in range(100)]


def test_numbers_that_round_to_zero_keep_their_sign(spark):
    values = [-4e-6, 4e-6, -0.0, 0.0, -6e-6, 0.123456, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(vectors.rounded(F.col("v"), 5)).collect()]
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.0", "0.0", "-1e-05", "0.12346", "nan", "None"]


def test_index_join_bit_for_bit(spark, tmp_path):
    from mosaiq.plans import catalog

    spark.createDataFrame([(1, "t", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [-1e-6, 1e-6, 0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert repr(catalog.QUERIES["index_join"](spark, str(tmp_path)).first()["vector"]) == "[-0.0, 0.0, 0.5]"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_files_are_split_where_rows_have_line_breaks(spark, tmp_path, monkeypatch, end):
    rng = random.Random(5)
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    texts = ["".join(rng.choices(['"', ",", "\n", "\r\n", "\r", "é", "word ", "a", "\n\n", '""\n'], k=rng.choice([1, 5, 40, 300]))) for _ in range(400)]
    texts += ["\n" * 9000, '"\n' * 4000, "", "x\n" * 6000]
    rng.shuffle(texts)
    (tmp_path / "in").mkdir()
    for name, part in (("a", texts[:150]), ("b", texts[150:])):
        lines = ["n,body,w"] + [f"{i},{quoted(t)},{rng.choice(['plain', '', quoted('q')])}" for i, t in enumerate(part)]
        for at in sorted(rng.sample(range(1, len(lines)), 20), reverse=True):
            lines.insert(at, "")
        (tmp_path / "in" / f"{name}.csv").write_bytes(end.join(lines).encode())
    schema = "n int, body string, w string"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        for path in (tmp_path / "in" / "a.csv", tmp_path / "in"):
            got = files.read_csv(spark, str(path), "body", ["n", "w"], schema=schema)
            assert "MapInArrow" in got._jdf.queryExecution().toString()
            split = sorted(map(tuple, got.collect()))
            with monkeypatch.context() as m:
                m.setattr(files, "_split_csv", lambda *_: None)
                assert split == sorted(map(tuple, files.read_csv(spark, str(path), "body", ["n", "w"], schema=schema).collect())) and len(split) > 100
        (tmp_path / "odd.csv").write_text("n,body,w\n" + "1,it is 6\" long,x\n2,plain,y\n" * 900)  # quotes that counting can't read
        assert files._split_csv(spark, str(tmp_path / "odd.csv"), schema) is None
        assert files.read_csv(spark, str(tmp_path / "odd.csv"), "body", schema=schema).count() == 1800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_csv_of_the_catalog_is_written_and_read_by_many_tasks(spark, sf, tmp_path):
    from mosaiq.plans import catalog

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        path = catalog._csv(spark, sf, True)
        docs = files.read_csv(spark, path, "text", schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert docs.rdd.getNumPartitions() > 1 and docs.count() == spark.read.parquet(f"{sf}/documents.parquet").where("trim(text) <> ''").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_small_text_files_are_few_tasks_and_are_not_written_by_the_driver(spark, sf, tmp_path, monkeypatch):
    from mosaiq.plans import catalog

    for i in range(1000):
        (tmp_path / f"d{i}.txt").write_text(f" text {i}\n")
    docs = files.read_text_folder(spark, str(tmp_path), ordered=False)
    assert docs.count() == 1000 and docs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    table = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'de'")

    def refuse(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(type(table), "toLocalIterator", refuse)
    assert catalog.QUERIES["scan_text_folder"](spark, sf).count() == table.where("trim(text) <> ''").count()


def test_a_stream_of_a_large_table_has_more_files_but_no_more_batches(spark, sf):
    from mosaiq.plans import catalog

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = catalog.QUERIES["stream_index"](spark, sf)
        folder = rows.inputFiles()[0].split("/store/")[0].removeprefix("file://")
        assert len([f for f in os.listdir(f"{folder}/in") if f.endswith(".parquet")]) > 6 and len(os.listdir(f"{folder}/checkpoint0/commits")) == 4  # two and their checksums
        assert rows.count() == rows.select("chunk_id").distinct().count() == catalog._c(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ascii_json_is_what_python_writes_and_costs_little_where_few_characters_need_it(spark):
    rng = random.Random(8)
    texts = ["", "plain", "é", "a\u00e9\u20ac\U0001f600z", "\x7f\x80\u2028", "\ud7ff\ue000\uffff\U0010ffff"] + ["".join(rng.choices("ab \"\\{\n" + "éß€漢\U0001f600\u0080", k=rng.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", batch.ascii_json(F.col("t")).alias("a")).collect()
    assert all(r["a"].isascii() and r["a"] == "".join(c if c < "\x80" else json.dumps(c)[1:-1] for c in r["t"]) for r in got)
    long = spark.range(3000, numPartitions=1).select(F.concat(F.lit("word " * 1000), F.when(F.col("id") >= 0, "é"), F.col("id").cast("string")).alias("t"))

    def took(df):
        began = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    took(long.limit(10).select(batch.ascii_json(F.col("t"))))
    assert took(long.select(batch.ascii_json(F.col("t")))) < 10 * took(long.select(F.sha2("t", 256))) + 0.5


def test_places_of_pieces(spark):
    from mosaiq.operators import chunking

    def of(text, fn, overlap=0):
        rows = chunking.custom_chunks(spark.createDataFrame([("d", text)], "document_id string, text string"), fn, overlap, python=False).orderBy("chunk_index").collect()
        return [(r["text"], r["start_char"], r["end_char"]) for r in rows]

    lines = lambda c: F.split(c, "\n")
    assert of("ab\n\né\U0001f600d\nab", lines) == [("ab", 0, 2), ("", 2, 2), ("é\U0001f600d", 4, 7), ("ab", 8, 10)]  # an empty piece is where the last one ended
    assert of("ab\nab", lines, 100) == [("ab", 0, 2), ("ab", 0, 2)]
    assert of("ab\ncd", lambda c: F.split(F.upper(c), "\n")) == [("AB", 0, 2), ("CD", 2, 4)]  # not found: the origin
    assert of(None, lines) == [] and of("", lines) == [("", 0, 0)]


def test_places_that_nobody_asks_for_are_not_looked_for(spark, sf):
    from mosaiq.plans import catalog

    plan = lambda name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "origins" not in plan("chunk_sentences") and "aggregate(" not in plan("chunk_sentences")
    assert "origins" in plan("chunk_origin") and "aggregate(" not in plan("chunk_origin")


def test_a_model_gets_bounded_parts_of_a_batch(spark):
    class Counting(models.Embedder):
        batch_size = 30

        def embed_texts(self, texts):
            return [[float(len(texts)), float(sum(map(len, texts)))] for _ in texts]

    rows = spark.range(5000, numPartitions=1).select("id", F.current_timestamp().alias("at"), F.concat(F.col("id").cast("string"), F.expr("repeat('x', if(id >= 3000, 60000, 5))")).alias("text"))
    got = Counting().embed(rows).select("id", "text", "vector", "at").where("id % 7 = 0 or id > 2900").select("id", F.length("text").alias("n"), "vector", "at").collect()
    assert {r["id"] for r in got} == {i for i in range(5000) if i % 7 == 0 or i > 2900} and all(r["at"] for r in got)
    assert max(r["vector"][0] for r in got) == 270 and max(r["vector"][1] for r in got) <= models.PART_BYTES
    assert {r["vector"][0] % 30 for r in got if r["id"] < 2900} == {0.0}
