"""The facade end to end on a small CSV, and the parts that the catalog's queries don't reach."""

import json

import pytest

from mosaiq.engine import Engine
from mosaiq.functions import filters
from mosaiq.functions.text import hash_vector_of
from mosaiq.operators import models
from mosaiq.operators.compare import QuerySpec
from mosaiq.operators.store import ChunkStore

ROWS = "team,year,speaker,body\nred,2020,Ann,water and power for all towns\nblue,2020,Ben,lower rates and wide roads\nred,2022,Cy,schools near every home\nblue,2022,Ann,trade with all neighbours\nred,2020,Di,clean rivers first\nblue,2020,Cy,roads before rails\n"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "talks.csv"
    path.write_text(ROWS)
    return str(path)


@pytest.fixture
def engine(spark, csv):
    return Engine.from_csv(spark, csv, "body", ["team", "year", "speaker"]).clean().chunk(200, 20).embed()


def test_one_response_for_each_query_and_cell(engine):
    assert engine.chunks.count() == 6
    assert engine.construct_cells(["team"]).count() == 2 and engine.construct_cells(["team", "year"]).count() == 4
    engine.compare(["who pays?", "what next?"], ["team", "year"], k=2)
    assert engine.responses.count() == 8


def test_csv_without_its_text_column_is_refused(spark, csv):
    with pytest.raises(ValueError):
        Engine.from_csv(spark, csv, "missing", ["team"]).documents.count()


def test_resume_skips_what_is_done(engine, tmp_path):
    path = str(tmp_path / "ck")
    engine.compare("who pays?", ["team"], checkpoint_path=path)
    assert engine.responses.count() == 2
    engine.compare(["who pays?", "what next?"], ["team"], checkpoint_path=path, resume=True)
    lines = engine.spark.read.text(path, recursiveFileLookup=True).count()
    assert lines == 4


def test_store_keeps_ids_once_and_filters_before_scoring(engine, tmp_path):
    engine.index(str(tmp_path / "store"))
    engine.index(str(tmp_path / "store"))
    store = ChunkStore(engine.spark, str(tmp_path / "store"))
    assert store.count() == 6
    query = hash_vector_of("roads", 12)
    got = store.search(query, 10, {"team": "blue"}).collect()
    assert len(got) == 3 and {r["team"] for r in got} == {"blue"}


def test_exports(engine, tmp_path):
    engine.compare("who pays?", ["team"])
    for kind in ("csv", "json"):
        engine.export_chunks(str(tmp_path / f"chunks-{kind}"), kind).export_responses(str(tmp_path / f"responses-{kind}"), kind)
    lines = engine.spark.read.text(str(tmp_path / "responses-json")).collect()
    assert len([json.loads(r[0]) for r in lines]) == 2


def test_operator_spellings_and_bad_sizes(engine):
    assert filters.normal_operator(" NEQ ") == "!=" and filters.normal_operator("Not  In") == "not in"
    with pytest.raises(ValueError):
        engine.chunk(10, 10).chunks.count()


def test_same_question_has_the_same_id():
    a, b = QuerySpec("who?", ["team"]), QuerySpec("who?", ["team"])
    assert a.query_id == b.query_id != QuerySpec("who?", ["year"]).query_id


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("busy")
        return "done"

    assert models.with_retries(call, retries=3, sleep=waits.append) == "done"
    assert waits == [1, 2, 4]
