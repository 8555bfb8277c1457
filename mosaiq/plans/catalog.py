"""Named queries over the test tables, each with DuckDB SQL where SQL can express it.

All run over whole tables. Where a query takes a limit, the limit is what it shows (top k, a queue, a preview).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import filters, vectors
from mosaiq.functions import text as X
from mosaiq.operators import batch, cells, checkpoint, chunking, compare, export, models, retrieval, store
from mosaiq.session import shared_folder, written
from mosaiq.sources import files
from mosaiq.streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZE, OVERLAP, K, DIM = 750, 100, 5, 12
QUESTION = "What is said about the future?"
QUESTIONS = [QUESTION, "Which words come first?", "How is the text put together?"]
META = ["lang", "source"]


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dl(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")


def _c(spark: SparkSession, d: str, meta: list[str] | None = None) -> DataFrame:
    return chunking.chunks(_t(spark, d, "documents"), SIZE, OVERLAP, id_col="doc_id", meta=META if meta is None else meta)


def _ce(spark: SparkSession, d: str, meta: list[str] | None = None) -> DataFrame:
    return models.MockEmbedder(DIM).embed(_c(spark, d, meta))


_ORDER = ["doc_id", "chunk_index"]
DL = "DL AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
C = f"""N AS (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {SIZE} THEN 1
 ELSE 1 + ceil((length(text) - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT END)) AS i FROM documents),
P AS (SELECT doc_id, lang, source, n_chars, i::INT AS chunk_index, substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}) AS text FROM N),
C AS (SELECT *, sha256(doc_id::VARCHAR || chr(31) || chunk_index::VARCHAR || chr(31) || text) AS chunk_id FROM P)"""
VEC = "list_transform(range({dim}), lambda k: (('0x' || substr(sha256({text}), 2 * (k % 32)::INT + 1, 2))::INT / 255.0) * 2.0 - 1.0)"
CE = f"{C}, CE AS (SELECT *, {VEC.format(dim=DIM, text='text')}::DOUBLE[] AS v FROM C)"


def _sql_vec(v: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- text ----


def _dirty() -> Column:
    c = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  \t")), F.lit("\n"), F.lit(" \r\n\n "))
    return F.concat(F.lit("\t"), c, F.lit("\xa0"))


_DIRTY = "(chr(9) || replace(replace(text, ' ', '  ' || chr(9)), chr(10), ' ' || chr(13) || chr(10) || chr(10) || ' ') || chr(160))"
_WHITE = " || ".join(f"chr({ord(c)})" for c in X.WHITE)
_CLEAN = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{}}, chr(13) || chr(10) || '?', chr(10), 'g'),
 '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{{{{2,}}}}', chr(10), 'g'), ' *' || chr(10) || ' *', chr(10), 'g'), {_WHITE})"""


@query(f"SELECT doc_id, {_CLEAN.format(_DIRTY)} AS clean_text FROM documents")
def clean_text(s, d):
    return _t(s, d, "documents").select("doc_id", X.clean(_dirty()).alias("clean_text"))


@query(f"SELECT doc_id, sha256({_DIRTY}) AS raw_hash, sha256({_CLEAN.format(_DIRTY)}) AS text_hash FROM documents")
def clean_preserve_raw(s, d):
    docs = chunking.clean_documents(_t(s, d, "documents").withColumn("text", _dirty()), preserve_raw=True)
    return docs.select("doc_id", X.text_hash(F.col("raw")).alias("raw_hash"), X.text_hash(F.col("text")).alias("text_hash"))


def _shout(text: str) -> str:
    return text.upper().replace(" ", "_")


@query("SELECT doc_id, sha256(replace(upper(regexp_replace(text, '[^ -~' || chr(10) || ']', '', 'g')), ' ', '_')) AS text_hash FROM documents WHERE lang = 'en'")
def clean_custom_python(s, d):
    docs = chunking.clean_documents(_t(s, d, "documents").where("lang = 'en'").withColumn("text", F.regexp_replace("text", "[^ -~\n]", "")), _shout, python=True)
    return docs.select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(s, d):
    return _t(s, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 137) || '...' ELSE text END AS preview FROM documents")
def truncate_text(s, d):
    return _t(s, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("preview"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
 '''', '&#x27;'), chr(10), '<br />') AS escaped FROM pages""")
def html_escape(s, d):
    return _t(s, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query(f"""SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS parts FROM documents""")
def split_context(s, d):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return _t(s, d, "documents").select("doc_id", X.split_context(doubled).alias("parts"))


@query("SELECT event_id, coalesce(CASE WHEN isnan(v) THEN NULL ELSE trunc(v)::BIGINT END, 0) AS whole, CASE WHEN isnan(v) THEN NULL ELSE trunc(v)::BIGINT END AS maybe FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN NULL ELSE value END AS v FROM events)")
def whole_numbers(s, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 1, F.col("value"))
    rows = _t(s, d, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", X.int_or(F.col("v"), 0).alias("whole"), X.int_or(F.col("v")).alias("maybe"))


@query("SELECT label, CASE WHEN starts_with(model, 'openai/') AND length(model) > 7 THEN substr(model, 8) ELSE model END AS model FROM (SELECT DISTINCT label, CASE WHEN label % 2 = 0 THEN 'openai/m' || label ELSE 'm' || label END AS model FROM embeddings)")
def model_names(s, d):
    told = _t(s, d, "embeddings").select("label").distinct().collect()  # labels of a classifier, a handful
    return s.createDataFrame([(r[0], X.normal_model(f"openai/m{r[0]}" if r[0] % 2 == 0 else f"m{r[0]}", "openai")) for r in told], "label int, model string")


@query(f"WITH {C} SELECT doc_id, chunk_index, text FROM C")
def chunk_explode(s, d):
    return _c(s, d, []).select("doc_id", "chunk_index", "text")


@query(f"WITH {C} SELECT doc_id, chunk_index, (chunk_index * {SIZE - OVERLAP})::INT AS start_char, (chunk_index * {SIZE - OVERLAP} + length(text))::INT AS end_char FROM C")
def chunk_offsets(s, d):
    return _c(s, d, []).select("doc_id", "chunk_index", "start_char", "end_char")


@query(f"WITH {C} SELECT doc_id, chunk_index, chunk_id FROM C")
def chunk_ids(s, d):
    return _c(s, d, []).select("doc_id", "chunk_index", "chunk_id")


@query("""WITH S AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, (i - 1)::INT AS chunk_index, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM S)""")
def chunk_sentences(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text")
    return chunking.custom_chunks(docs, chunking.sentences, python=False, id_col="doc_id", meta=[]).select("doc_id", "chunk_index", "text")


def _pairs(text: str) -> list[str]:
    """Pieces of two lines."""
    lines = text.split("\n")
    return ["\n".join(lines[i : i + 2]) for i in range(0, len(lines), 2)]


@query(f"""WITH S AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
P AS (SELECT doc_id, text, unnest(range(0, (len(l) + 1) // 2)) AS i, l FROM S), Q AS (SELECT doc_id, text, i::INT AS chunk_index, array_to_string(l[2 * i + 1 : 2 * i + 2], chr(10)) AS piece FROM P)
SELECT doc_id, chunk_index, sha256(doc_id::VARCHAR || chr(31) || chunk_index::VARCHAR || chr(31) || piece) AS chunk_id, sha256(piece) AS text FROM Q WHERE text <> ''""")
def chunk_custom_python(s, d):
    got = chunking.custom_chunks(_t(s, d, "documents").select("doc_id", "text"), _pairs, overlap=0, id_col="doc_id", meta=[])
    return got.select("doc_id", "chunk_index", "chunk_id", X.text_hash(F.col("text")).alias("text"))


@query("""WITH RECURSIVE S AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
R(doc_id, i, starts, upto) AS (SELECT doc_id, 1, 0, length(l[1]) FROM S UNION ALL
 SELECT doc_id, i + 1, a, a + length(l[i + 1]) FROM (SELECT R.doc_id, i, l, CASE WHEN instr(substr(text, greatest(upto - 100, 0) + 1), l[i + 1]) > 0 THEN greatest(upto - 100, 0) + instr(substr(text, greatest(upto - 100, 0) + 1), l[i + 1]) - 1 ELSE greatest(upto - 100, 0) END AS a
 FROM R JOIN S ON R.doc_id = S.doc_id WHERE i < len(l)))
SELECT doc_id, (i - 1)::INT AS chunk_index, starts::INT AS start_char, upto::INT AS end_char FROM R""")
def chunk_origin(s, d):
    """Where a custom chunker's pieces begin: looked for from the last piece's end less the overlap."""
    got = chunking.custom_chunks(_t(s, d, "documents").select("doc_id", "text"), lambda c: F.split(c, "\n"), overlap=100, python=False, id_col="doc_id", meta=[])
    return got.select("doc_id", "chunk_index", "start_char", "end_char")


# ---- metadata ----


def _cells(fields: list[str], base: str, where: str) -> str:
    spelled = " || '|' || ".join(f"'{f}=' || {f}::VARCHAR" for f in sorted(fields))
    return f"WITH {DL} SELECT DISTINCT {spelled} AS cell_id, {', '.join(fields)} FROM {base} WHERE {where}"


@query(_cells(["lang"], "documents", "lang IS NOT NULL"))
def cells_1field(s, d):
    return cells.construct_cells(_c(s, d), ["lang"])


@query(_cells(["lang", "source"], "documents", "lang IS NOT NULL AND source IS NOT NULL"))
def cells_2field(s, d):
    return cells.construct_cells(_c(s, d), ["lang", "source"])


@query(_cells(["lang", "source", "quality"], "DL", "lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL"))
def cells_3field(s, d):
    return cells.construct_cells(_dl(s, d), ["lang", "source", "quality"])


@query(_cells(["quality", "toxic"], "DL", "quality IS NOT NULL AND toxic IS NOT NULL"))
def cells_numeric(s, d):
    return cells.construct_cells(_dl(s, d), ["quality", "toxic"])


@query(f"WITH {DL} SELECT DISTINCT 'lang=' || lang || '|quality=' || coalesce(quality::VARCHAR, 'None') AS cell_id, lang, quality FROM DL")
def cells_null_meta(s, d):
    return cells.construct_cells(_dl(s, d), ["lang", "quality"], include_null_cells=True)


@query(f"WITH {DL} SELECT DISTINCT 'lang=' || lang || '|source=' || source AS cell_id, 'lang=' || lang || ' | source=' || source AS label FROM DL")
def cell_label(s, d):
    c = cells.construct_cells(_dl(s, d), META)
    return c.select("cell_id", cells.cell_label(c, META).alias("label"))


@query(f"WITH {C} SELECT chunk_id FROM C WHERE lang = 'en' AND source = 'src1'")
def chunks_for_cell(s, d):
    return cells.chunks_for_cell(_c(s, d), {"lang": "en", "source": "src1"}).select("chunk_id")


@query(f"WITH {C} SELECT lang, source, count(*) AS n FROM C GROUP BY ALL")
def chunks_per_cell(s, d):
    return _c(s, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DL} SELECT value, row_number() OVER (ORDER BY value::VARCHAR)::INT AS ord FROM (SELECT DISTINCT source AS value FROM DL)")
def distinct_values(s, d):
    return cells.unique_values(_dl(s, d), "source")


@query("""SELECT field, list_sort(list_distinct(list(value))) AS values FROM
 (SELECT unnest(['lang', 'source']) AS field, unnest([lang, source]) AS value FROM documents) GROUP BY field""")
def list_metadata_values(s, d):
    return cells.list_metadata_values(_t(s, d, "documents"), META)


@query("SELECT value, row_number() OVER (ORDER BY value)::INT AS ord FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS value FROM events) WHERE value IS NOT NULL")
def list_metadata_json(s, d):
    values = cells.list_metadata_values(_t(s, d, "events"), ["k"], "props").select(F.posexplode("values").alias("ord", "value"))
    return values.select("value", (F.col("ord") + 1).alias("ord"))


@query(f"""WITH {DL} SELECT doc_id, '{{"lang":"' || lang || '","quality":' || coalesce(quality::VARCHAR, 'null') || ',"source":"' || source || '","toxic":' || coalesce(toxic::VARCHAR, 'null') || '}}' AS metadata_json FROM DL""")
def metadata_json(s, d):
    dl = _dl(s, d)
    return dl.select("doc_id", cells.metadata_json(dl, ["source", "lang", "toxic", "quality"]).alias("metadata_json"))


@query("""SELECT event_id, '{"a":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE (event_id % 5)::VARCHAR || '.5' END || ',"bytes":"' || event_type || '","list":[' || event_id % 4 || ',null],"nested":{"k":"' || user_id || '","z":' || event_id % 2 || '}}' AS metadata_json FROM events""")
def metadata_json_nested(s, d):
    n = F.col("event_id")
    rows = _t(s, d, "events").select(
        "event_id", F.struct((n % 2).alias("z"), F.col("user_id").cast("string").alias("k")).alias("nested"), F.array(n % 4, F.lit(None).cast("bigint")).alias("list"), F.col("event_type").cast("binary").alias("bytes"),
        F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(n % 5 + 0.5).alias("a"),
    )
    return rows.select("event_id", cells.metadata_json(rows, ["nested", "list", "bytes", "a"]).alias("metadata_json"))


@query("""SELECT field, CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'bool' WHEN bool_and(try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) THEN 'int'
 WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'string' END AS kind
FROM (SELECT unnest(['event_type', 'k', 'user_id', 'value']) AS field, unnest([event_type, json_extract_string(props, '$.k'), user_id::VARCHAR, value::VARCHAR]) AS v FROM events) GROUP BY field""")
def metadata_types(s, d):
    e = _t(s, d, "events")
    spelled = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("v")) for n, c in [("event_type", F.col("event_type")), ("k", F.get_json_object("props", "$.k")), ("user_id", F.col("user_id")), ("value", F.col("value"))]]))
    return e.select(spelled).groupBy("field").agg(cells.inferred_kind(F.col("v")).alias("kind"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def metadata_fields(s, d):
    return cells.metadata_fields(_t(s, d, "events"), "props")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(s, d):
    return chunking.duplicate_ids(_t(s, d, "conversations"), "conv_id")


_FLAT = f"WITH {C} SELECT chunk_id, doc_id AS document_id, sha256(text) AS text, chunk_index, (chunk_index * {SIZE - OVERLAP})::INT AS start_char, (chunk_index * {SIZE - OVERLAP} + length(text))::INT AS end_char, lang, source FROM C"


def _named(s, d) -> DataFrame:
    return _c(s, d).withColumnRenamed("doc_id", "document_id").withColumn("text", X.text_hash(F.col("text")))


@query(_FLAT)
def chunks_dataframe(s, d):
    return cells.chunks_dataframe(_named(s, d), META)


# ---- filters ----


def _filter(name: str, spec: dict, where: str) -> None:
    def run(s, d):
        dl = _dl(s, d)
        return dl.where(filters.compile_filter(dl, spec)).select("doc_id")

    query(f"WITH {DL} SELECT doc_id FROM DL WHERE {where}", name)(run)


_filter("filter_eq", {"lang": "en"}, "lang = 'en'")
_filter("filter_in_list", {"source": ["src1", "src2", None, "none"], "lang": ("en", "fr")}, "source IN ('src1', 'src2') AND lang IN ('en', 'fr')")
_filter("filter_ops_ne", {"quality": {"op": "!=", "value": 1}}, "quality <> 1")
_filter("filter_ops_gt", {"n_chars": {"op": ">", "value": 1000}}, "n_chars > 1000")
_filter("filter_ops_ge", {"quality": {"op": ">=", "value": 1}}, "quality >= 1")
_filter("filter_ops_lt", {"n_chars": {"op": "<", "value": 500.5}}, "n_chars < 500.5")
_filter("filter_ops_le", {"toxic": {"op": "<=", "value": 0}}, "toxic <= 0")
_filter("filter_ops_in", {"quality": {"op": "in", "value": [0, None, "x"]}}, "quality IN (0)")
_filter("filter_ops_notin", {"quality": {"op": "not in", "value": [0, None]}}, "quality IS NOT NULL AND quality NOT IN (0)")
_filter("filter_ops_isnull", {"quality": {"op": "is null"}}, "quality IS NULL")
_filter("filter_ops_notnull", {"quality": {"op": "is not null"}}, "quality IS NOT NULL")
_filter("filter_ops_alias", {"n_chars": {"op": "GTE", "value": 700}, "lang": {"op": "neq", "value": "de"}}, "n_chars >= 700 AND lang <> 'de'")
_filter("filter_clauses_and", {"__logic__": "and", "__clauses__": [{"field": "lang", "op": "==", "value": "en"}, {"field": "quality", "op": "eq", "value": 1}, {"op": "=", "value": 3}]}, "lang = 'en' AND quality = 1")
_filter("filter_clauses_or", {"__logic__": "OR", "__clauses__": [{"field": "toxic", "op": "=", "value": 1}, {"field": "source", "op": "in", "value": ["src3"]}]}, "toxic = 1 OR source = 'src3'")
_filter("filter_like", {"source": {"op": "like", "value": "src1%"}}, "source LIKE 'src1%'")
_filter("filter_raw_expr", {"__filter_expr__": "length(text) > 2000 AND lang IN ('en', 'de')", "lang": "fr"}, "length(text) > 2000 AND lang IN ('en', 'de')")


@query(f"WITH {DL} SELECT doc_id FROM DL WHERE n_chars >= 500 AND quality = 1 AND lang = 'en' AND source = 'src1'")
def filter_combined(s, d):
    dl = _dl(s, d)
    base = {"__logic__": "and", "__clauses__": [{"field": "n_chars", "op": ">=", "value": 500}, {"field": "quality", "op": "=", "value": 1}]}
    return dl.where(filters.combined(dl, base, {"lang": "en", "source": "src1"})).select("doc_id")


@query(f"WITH {DL} SELECT doc_id FROM DL WHERE lang IN ('en', 'fr') AND n_chars > 300 AND quality IS NOT NULL")
def filter_subset(s, d):
    dl = _dl(s, d)
    spec = filters.conditions([("lang", "in", "en, fr"), ("n_chars", "gt", "300"), ("quality", "isnotnull", ""), ("source", "=", " ")])
    return dl.where(filters.compile_filter(dl, spec)).select("doc_id")


@query(f"WITH {DL} SELECT doc_id FROM DL WHERE source = 'src7' OR n_chars < 99.5 OR quality IN (0, 5)")
def filter_parse(s, d):
    dl = _dl(s, d)
    rows = [("source", "=", "'src7'"), ("n_chars", "<", "99.5"), ("quality", "in", "0, 5,")]
    spec = {**filters.conditions(rows), "__logic__": "or"}
    return dl.where(filters.compile_filter(dl, spec)).select("doc_id")


@query(f"WITH {DL} SELECT doc_id FROM DL WHERE lang IN ('en', 'de') AND n_chars >= 300 AND source LIKE 'src%' AND quality IS NOT NULL")
def filter_as_sql(s, d):
    """A filter's own SQL text, run by the engine."""
    dl = _dl(s, d)
    spec = filters.conditions([("lang", "in", "en, de"), ("n_chars", "gte", "300"), ("source", "like", "src%"), ("quality", "isnotnull", "")])
    return dl.where(F.expr(filters.to_sql(spec))).select("doc_id")


_MANY = [("n_chars", ">", str(10 * i)) for i in range(12)]


@query(f"SELECT 'n_chars > ' || max(i * 10) AS last, count(*) AS n FROM range({len(_MANY)}) t(i)")
def filter_summary(s, d):
    """All conditions of a form take part, and its summary names them."""
    told = filters.summary(filters.conditions(_MANY)).split(" AND ")
    return s.createDataFrame([(told[-1], len(told))], "last string, n bigint")


# ---- vectors ----


_ROUND = "list_transform({}, lambda x: round(x::DOUBLE, 6))"


@query(f"SELECT doc_id, {_ROUND.format(VEC.format(dim=DIM, text='text'))} AS vector FROM documents")
def mock_embed(s, d):
    return _t(s, d, "documents").select("doc_id", F.transform(X.hash_vector(F.col("text"), DIM), lambda x: F.round(x, 6)).alias("vector"))


def _service(model: str, texts: list[str]) -> list[dict]:
    """A provider that answers out of order."""
    return [{"index": i, "embedding": X.hash_vector_of(t, DIM)} for i, t in reversed(list(enumerate(texts)))]


@query(f"SELECT doc_id, {_ROUND.format(VEC.format(dim=DIM, text='text'))} AS vector, 'm' AS embedding_model FROM documents")
def provider_embed(s, d):
    got = models.ProviderEmbedder(_service, "m", batch_size=7).embed(_t(s, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "embedding_model")


def _vector0(s, d) -> list[float]:
    """The vector of the least vec_id, as a driver-side query."""
    e = _t(s, d, "embeddings")
    return [float(x) for x in e.agg(F.min_by("embedding", "vec_id")).first()[0]]


_Q0 = "Q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings)"
_SIM = "list_cosine_similarity(embedding::DOUBLE[], q)"


@query(f"WITH {_Q0} SELECT vec_id, round({_SIM}, 6) AS score FROM embeddings, Q")
def cosine_scores(s, d):
    return _t(s, d, "embeddings").select("vec_id", vectors.rounded(vectors.cosine_to(F.col("embedding"), _vector0(s, d)), 6).alias("score"))


@query(f"WITH {_Q0} SELECT vec_id, round(-power(list_distance(embedding::DOUBLE[], q), 2), 6) + 0.0 AS score FROM embeddings, Q")
def l2_scores(s, d):
    return _t(s, d, "embeddings").select("vec_id", (F.round(vectors.l2_score_to(F.col("embedding"), _vector0(s, d)), 6) + 0.0).alias("score"))


@query("SELECT vec_id, len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS ok FROM embeddings")
def vector_validate(s, d):
    return _t(s, d, "embeddings").select("vec_id", vectors.finite(F.col("embedding")).alias("ok"))


def _ranked_sql(where: str) -> str:
    return f"""WITH {_Q0}, R AS (SELECT vec_id, {_SIM} AS x FROM embeddings, Q WHERE {where})
SELECT vec_id, row_number() OVER (ORDER BY x DESC, vec_id)::INT AS rk, round(x, 6) AS score FROM R QUALIFY rk <= {K}"""


def _topk(s, d, spec) -> DataFrame:
    from pyspark.sql import Window

    top = retrieval.similarity_search(_t(s, d, "embeddings"), _vector0(s, d), K, spec, order=["vec_id"], vector_col="embedding")
    return top.select("vec_id", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rk"), vectors.rounded(F.col("score"), 6).alias("score"))


@query(_ranked_sql("true"))
def similarity_topk(s, d):
    return _topk(s, d, None)


@query(_ranked_sql("label IN (1, 2)"))
def similarity_topk_filtered(s, d):
    return _topk(s, d, {"label": [1, 2]})


@query(f"""WITH {_Q0}, R AS (SELECT label, vec_id, {_SIM} AS x FROM embeddings, Q)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id)::INT AS rk, round(x, 6) AS score FROM R QUALIFY rk <= {K}""")
def topk_per_cell(s, d):
    top = retrieval.per_cell(_t(s, d, "embeddings"), ["label"], [{"query_id": "q", "vector": _vector0(s, d), "k": K}], order=["vec_id"], vector_col="embedding")
    return top.select("label", "vec_id", F.col("rank").alias("rk"), vectors.rounded(F.col("score"), 6).alias("score"))


def _store(s, d) -> store.ChunkStore:
    """A store of all chunks, in two batches: the second adds and replaces."""
    chunks = _ce(s, d).withColumn("document_id", F.col("doc_id").cast("string")).drop("doc_id")
    kept = store.ChunkStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    kept.add(chunks.where("lang <> 'fr'"), META, ["document_id", "chunk_index"])
    kept.add(chunks.where("lang in ('fr', 'de')"), META, ["document_id", "chunk_index"])
    return kept


@query(f"WITH {C} SELECT chunk_id, doc_id::VARCHAR AS document_id, chunk_index FROM C WHERE chunk_id = (SELECT min(chunk_id) FROM C)")
def get_chunk(s, d):
    kept = _store(s, d)
    return kept.get_chunk(kept.read().agg(F.min("chunk_id")).first()[0]).select("chunk_id", "document_id", "chunk_index")


@query(f"WITH {C} SELECT chunk_id, doc_id::VARCHAR AS document_id, chunk_index FROM C SEMI JOIN (SELECT DISTINCT doc_id, 0 AS chunk_index FROM labels) USING (doc_id, chunk_index)")
def chunks_by_ids(s, d):
    ids = _c(s, d).where("chunk_index = 0").join(_t(s, d, "labels"), "doc_id", "left_semi").select("chunk_id")
    return _store(s, d).chunks_by_ids(ids).select("chunk_id", "document_id", "chunk_index")


@query(f"WITH {C} SELECT count(*) AS n, count(DISTINCT chunk_id) AS n_ids FROM C")
def store_count(s, d):
    kept = _store(s, d)
    return s.createDataFrame([(kept.count(), kept.ids().count())], "n bigint, n_ids bigint")


@query("""SELECT field, list_sort(list_distinct(list(value))) AS values FROM
 (SELECT unnest(['lang', 'source']) AS field, unnest([lang, source]) AS value FROM documents WHERE text <> '') GROUP BY field""")
def store_metadata_values(s, d):
    return _store(s, d).list_metadata_values(META)


_SEARCH = f"""WITH {CE}, R AS (SELECT chunk_id, doc_id::VARCHAR AS doc, chunk_index, list_cosine_similarity(v::FLOAT[]::DOUBLE[], {_sql_vec(X.hash_vector_of(QUESTION, DIM))}) AS x FROM CE WHERE lang IN ('en', 'de'))
SELECT chunk_id, round(x, 5) AS score FROM R ORDER BY x DESC, doc, chunk_index LIMIT {K}"""


@query(_SEARCH)
def store_search(s, d):
    got = _store(s, d).search(X.hash_vector_of(QUESTION, DIM), K, {"lang": ["en", "de"]})
    return got.select("chunk_id", vectors.rounded(F.col("score"), 5).alias("score"))


@query(_SEARCH.replace("v::FLOAT[]::DOUBLE[]", "v").replace("doc_id::VARCHAR AS doc", "doc_id AS doc"))
def memory_store_search(s, d):
    kept, rows = store.MemoryStore(), _ce(s, d)
    for some in ("lang <> 'fr'", "lang in ('fr', 'de')"):  # what is added again replaces
        kept.add(rows.where(some), META, _ORDER)
    return kept.search(X.hash_vector_of(QUESTION, DIM), K, {"lang": ["en", "de"]}).select("chunk_id", vectors.rounded(F.col("score"), 5).alias("score"))


@query(f"""WITH {CE}, R AS (SELECT chunk_id, doc_id, chunk_index, list_cosine_similarity(v, {_sql_vec(X.hash_vector_of(QUESTION, DIM))}) AS x FROM CE WHERE lang = 'en')
SELECT chunk_id, row_number() OVER (ORDER BY x DESC, doc_id, chunk_index)::INT AS rk, round(x, 6) AS score FROM R QUALIFY rk <= {K}""")
def retrieve(s, d):
    from pyspark.sql import Window

    r = retrieval.Retriever(_ce(s, d), models.MockEmbedder(DIM).embed_query, K, order=_ORDER)
    top = r.retrieve(QUESTION, {"lang": "en"})
    return top.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), *_ORDER)).alias("rk"), vectors.rounded(F.col("score"), 6).alias("score"))


# ---- comparative queries ----


def _top_sql(questions: list[str], where: str = "true", fields: str = "lang, source", k: int = K) -> str:
    values = ", ".join(f"('q{i + 1}', {_sql_text(q)}, {_sql_vec(X.hash_vector_of(q, DIM))})" for i, q in enumerate(questions))
    return f"""{CE}, QS(query_id, query_text, q) AS (VALUES {values}),
T AS (SELECT query_id, query_text, lang, source, doc_id, chunk_index, chunk_id, text,
 row_number() OVER (PARTITION BY query_id, {fields} ORDER BY list_cosine_similarity(v, q) DESC, doc_id, chunk_index)::INT AS rk FROM CE, QS WHERE {where} QUALIFY rk <= {k})"""


_CELL = "'lang=' || lang || '|source=' || source"


def _top(s, d, questions=(QUESTION,), base=None) -> DataFrame:
    embedder = models.MockEmbedder(DIM)
    queries = [{"query_id": f"q{i + 1}", "vector": embedder.embed_query(q), "k": K} for i, q in enumerate(questions)]
    top = retrieval.per_cell(_ce(s, d, [*META, "n_chars"]), META, queries, base, order=_ORDER)
    return compare.with_cell_id(top, META)


def _contexts(s, d) -> DataFrame:
    got = compare.contexts(_top(s, d), META)
    return compare.with_cell_id(got, META)


@query(f"WITH {_top_sql([QUESTION])} SELECT {_CELL} AS cell_id, rk, chunk_id FROM T")
def compare_retrieval(s, d):
    return _top(s, d).select("cell_id", F.col("rank").alias("rk"), "chunk_id")


_AGG = f"{_CELL} AS cell_id, list(text ORDER BY rk) AS texts, count(*) AS n FROM T GROUP BY lang, source"


@query(f"WITH {_top_sql([QUESTION])}, A AS (SELECT {_AGG}) SELECT cell_id, length(array_to_string(texts, chr(10) || chr(10)))::INT AS n_chars, sha256(array_to_string(texts, chr(10) || chr(10))) AS context FROM A")
def retrieved_context(s, d):
    c = X.plain_context(F.col("texts"))
    return _contexts(s, d).select("cell_id", F.length(c).alias("n_chars"), F.sha2(c, 256).alias("context"))


@query(f"""WITH {_top_sql([QUESTION])}, A AS (SELECT {_AGG}),
B AS (SELECT cell_id, 'Context:' || chr(10) || array_to_string(list_transform(texts, lambda t, i: '[Chunk ' || i || ']' || chr(10) || t), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || {_sql_text(QUESTION)} || chr(10) || chr(10) || 'Additional instructions: Be brief.' AS p FROM A)
SELECT cell_id, length(p)::INT AS n_chars, sha256(p) AS prompt FROM B""")
def prompt_build(s, d):
    p = X.user_prompt(F.lit(QUESTION), F.col("texts"), " Be brief. ")
    return _contexts(s, d).select("cell_id", F.length(p).alias("n_chars"), F.sha2(p, 256).alias("prompt"))


_MOCK = f"'[MOCK RESPONSE] Query: ' || {_sql_text(QUESTION)} || '. Chunks: ' || n || '. Snippet: ' || replace(substr(texts[1], 1, 120), chr(10), ' ') || '.'"


def _responses(s, d, base=None) -> DataFrame:
    runner = compare.Runner(_ce(s, d), models.MockEmbedder(DIM), models.MockGenerator(), order=_ORDER)
    return runner.run([compare.QuerySpec(QUESTION, META, "q1", K, generation_model=None)], base=base)


@query(f"WITH {_top_sql([QUESTION])}, A AS (SELECT {_AGG}) SELECT cell_id, n::INT AS n, {_MOCK} AS response_text FROM A")
def compare_mock(s, d):
    return _responses(s, d).select("cell_id", F.size("retrieved_chunk_ids").alias("n"), "response_text")


@query(f"WITH {_top_sql(QUESTIONS)} SELECT query_id, {_CELL} AS cell_id, rk, chunk_id FROM T")
def compare_multi_query(s, d):
    return _top(s, d, QUESTIONS).select("query_id", "cell_id", F.col("rank").alias("rk"), "chunk_id")


@query(f"WITH {_top_sql([QUESTION], where="lang IN ('en', 'fr') AND n_chars >= 500")} SELECT {_CELL} AS cell_id, count(*) AS n FROM T GROUP BY ALL")
def compare_subset(s, d):
    base = {"lang": ["en", "fr"], "n_chars": {"op": ">=", "value": 500}}
    return _top(s, d, base=base).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_top_sql([QUESTION])}, A AS (SELECT lang, source, {_AGG})
SELECT 'q1' AS query_id, {_sql_text(QUESTION)} AS query_text, cell_id, {_MOCK} AS response_text, 'mock-generator' AS model_name, 'mock-embedder' AS embedding_model, n::INT AS retrieved_chunk_count, lang, source, '' AS metadata FROM A""")
def responses_flat(s, d):
    return export.flat_responses(_responses(s, d), include_context=False).drop("response_id", "timestamp")


@query(f"""WITH {_top_sql([QUESTION])}, A AS (SELECT lang, source, list(chunk_id ORDER BY rk) AS ids, {_AGG})
SELECT 'response_id query_id query_text cell_id cell_filter retrieved_chunk_ids retrieved_context response_text model_name embedding_model_name timestamp metadata' AS keys, 'q1' AS query_id, {_sql_text(QUESTION)} AS query_text, cell_id,
 '{{"lang":"' || lang || '","source":"' || source || '"}}' AS cell_filter, '["' || array_to_string(ids, '","') || '"]' AS ids, sha256(array_to_string(texts, chr(10) || chr(10))) AS context, {_MOCK} AS response_text, 'mock-generator' AS model_name, '' AS metadata FROM A""")
def responses_json(s, d):
    """The lines of the JSON export, read again field by field; ids and times are made anew by each run."""
    lines = export.response_lines(_responses(s, d))
    field = {k: F.get_json_object("value", f"$.{k}") for k in ("query_id", "query_text", "cell_id", "cell_filter", "response_text", "model_name", "metadata")}
    return lines.select(
        F.array_join(F.json_object_keys("value"), " ").alias("keys"), *[v.alias(k) for k, v in field.items()], F.get_json_object("value", "$.retrieved_chunk_ids").alias("ids"),
        F.sha2(F.get_json_object("value", "$.retrieved_context"), 256).alias("context"),
    )


@query(f"WITH {_top_sql([QUESTION])}, A AS (SELECT lang, source, {_AGG}), R AS (SELECT lang, source, {_MOCK} AS r FROM A) SELECT lang, source, CASE WHEN length(r) > 140 THEN substr(r, 1, 137) || '...' ELSE r END AS Response FROM R")
def responses_preview(s, d):
    return export.preview(_responses(s, d))


class _Chat:
    """A chat service's client, which answers with what it was told."""

    def __call__(self, model: str, messages: list[dict], **params) -> dict:
        told = "\n".join(m["content"] for m in messages[1:])
        return {"choices": [{"message": {"content": f"{model}/{params.get('temperature')}/{len(told)}/{told[-30:]}"}}]}


@query(f"""WITH {_top_sql([QUESTION])}, A AS (SELECT {_AGG}),
B AS (SELECT cell_id, 'Context:' || chr(10) || array_to_string(list_transform(texts, lambda t, i: '[Chunk ' || i || ']' || chr(10) || t), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || {_sql_text(QUESTION)} || chr(10) || chr(10) || 'Additional instructions: ' AS p FROM A),
ASKED AS (SELECT * FROM (VALUES ('q1', 'Be brief.', 'm1', '0.5'), ('q2', 'Be long.', 'm1', '0.5'), ('q3', 'Be brief.', 'm1', '1'), ('q4', 'Be brief.', 'm2', '1')) t(query_id, i, m, temp))
SELECT query_id, cell_id, m || '/' || temp || '/' || length(p || i) || '/' || right(p || i, 30) AS response_text, m AS model_name FROM B, ASKED""")
def compare_providers(s, d):
    """One question asked in four ways: instructions, model and parameters of each are its own."""
    runner = compare.Runner(_ce(s, d), models.MockEmbedder(DIM), models.ProviderGenerator(_Chat(), "m0"), order=_ORDER)
    asked = [("q1", "Be brief.", "m1", 0.5), ("q2", "Be long.", "m1", 0.5), ("q3", "Be brief.", "m1", 1), ("q4", "Be brief.", "m2", 1)]
    specs = [compare.QuerySpec(QUESTION, META, i, K, note, m, {"temperature": t}) for i, note, m, t in asked]
    return runner.run(specs).select("query_id", "cell_id", "response_text", "model_name")


@query(f"""WITH {_top_sql([QUESTION], where="n_chars >= 400")}, A AS (SELECT lang, source, {_AGG}), F AS (SELECT DISTINCT lang, source, {_CELL} AS cell_id FROM C)
SELECT cell_id, coalesce(n, 0)::INT AS n FROM F LEFT JOIN A USING (cell_id)""")
def engine_compare(s, d):
    """The facade from documents to answers, on a store, with a filter that leaves some cells empty."""
    from mosaiq.engine import Engine

    docs = _t(s, d, "documents").withColumn("document_id", F.col("doc_id").cast("bigint")).drop("doc_id")
    e = Engine.from_documents(docs).chunk(SIZE, OVERLAP).embed(models.MockEmbedder(DIM)).index(f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    e.compare(QUESTION, META, k=K, base={"n_chars": {"op": ">=", "value": 400}})
    return e.responses.select("cell_id", F.size("retrieved_chunk_ids").alias("n"))


@query(_FLAT)
def export_chunks_flat(s, d):
    return export.flat_chunks(_named(s, d), META)


@query(f"""WITH {C} SELECT chunk_id, sha256('{{"chunk_id":"' || chunk_id || '","document_id":' || doc_id || ',"chunk_index":' || chunk_index || ',"start_char":' || chunk_index * {SIZE - OVERLAP} || ',"end_char":' || (chunk_index * {SIZE - OVERLAP} + length(text))
 || ',"text":' || to_json(text)::VARCHAR || ',"metadata":{{"lang":"' || lang || '","source":"' || source || '"}}}}') AS line FROM C""")
def export_chunks_json(s, d):
    lines = export.chunk_lines(_c(s, d).withColumnRenamed("doc_id", "document_id"), META)
    return lines.select(F.get_json_object("value", "$.chunk_id").alias("chunk_id"), F.sha2("value", 256).alias("line"))


@query(f"WITH {_top_sql([QUESTION])}, A AS (SELECT {_AGG}) SELECT 'q1' AS query_id, cell_id, n::INT AS n, {_MOCK} AS response_text FROM A")
def checkpoint_roundtrip(s, d):
    ck = checkpoint.Checkpoint(s, f"{shared_folder(s)}/responses-{uuid.uuid4().hex}")
    runner = compare.Runner(_ce(s, d), models.MockEmbedder(DIM), models.MockGenerator(), order=_ORDER)
    spec = compare.QuerySpec(QUESTION, META, "q1", K, generation_model=None)
    runner.run([spec], base={"lang": "en"}, cells_from=cells.chunks_for_cell(_c(s, d), {"lang": "en"}), checkpoint=ck)
    runner.run([spec], checkpoint=ck, resume=True)
    return checkpoint.load_responses(s, ck.path).select("query_id", "cell_id", F.size("retrieved_chunk_ids").alias("n"), "response_text")


@query(f"SELECT DISTINCT {_CELL} AS cell_id FROM documents WHERE lang <> 'en'")
def resume_anti(s, d):
    c = cells.construct_cells(_t(s, d, "documents"), META)
    done = checkpoint.processed_keys(c.where("lang = 'en'").select(F.lit("q1").alias("query_id"), "cell_id"))
    return c.withColumn("query_id", F.lit("q1")).join(done, ["query_id", "cell_id"], "left_anti").select("cell_id")


# ---- store and batch ----


@query("SELECT doc_id, lang, list_transform(embedding, lambda x: round(x::DOUBLE, 5)) AS vector FROM documents JOIN embeddings ON doc_id = vec_id")
def index_join(s, d):
    vectors_ = _t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("m").alias("embedding_model"))
    rows = store.index_rows(_t(s, d, "documents").withColumnRenamed("doc_id", "chunk_id"), vectors_)
    return rows.select(F.col("chunk_id").alias("doc_id"), "lang", F.transform("vector", lambda x: vectors.rounded(x.cast("double"), 5)).alias("vector"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def skip_existing_anti(s, d):
    return store.skip_existing(_t(s, d, "documents"), _t(s, d, "labels"), "doc_id").select("doc_id")


@query("SELECT DISTINCT doc_id FROM labels SEMI JOIN documents USING (doc_id)")
def existing_ids_semi(s, d):
    return store.existing(_t(s, d, "documents"), _t(s, d, "labels"), "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, NULL FROM documents ANTI JOIN labels USING (doc_id)")
def store_append_align(s, d):
    old = _t(s, d, "labels").where("toxic = 0").select("doc_id", "quality")
    new = _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")
    return old.unionByName(store.align(new, old))


@query(f"WITH {C} SELECT chunk_id FROM C WHERE lang IN ('fr', 'de') AND source = 'src3' AND chunk_index > 1")
def store_scan_filtered(s, d):
    return _store(s, d).scan({"lang": ["fr", "de"], "source": "src3", "chunk_index": {"op": ">", "value": 1}}).select("chunk_id")


@query(f"""WITH K AS (SELECT DISTINCT sha256(text) AS h FROM documents SEMI JOIN labels USING (doc_id))
SELECT doc_id, {_ROUND.format(VEC.format(dim=DIM, text='text'))} AS vector, sha256(text) IN (SELECT h FROM K) AS hit FROM documents""")
def embedding_cache_lookup(s, d):
    """Labelled documents fill a cache; then all documents go through it."""
    docs, cache = _t(s, d, "documents").select("doc_id", "text"), models.EmbeddingCache(s, f"{shared_folder(s)}/cache-{uuid.uuid4().hex}")
    model = models.CachedEmbedder(models.ProviderEmbedder(_service, "m"), cache)
    model.embed(docs.join(_t(s, d, "labels"), "doc_id", "left_semi"))
    had = written(cache.vectors("m").select("text_hash", F.lit(True).alias("had")))
    got = model.embed(docs).withColumn("text_hash", X.text_hash(F.col("text"))).join(had, "text_hash", "left")
    return got.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), F.coalesce("had", F.lit(False)).alias("hit"))


@query("SELECT count(DISTINCT sha256(text)) AS n, count(DISTINCT sha256(text)) AS n_hashes FROM documents")
def embedding_cache_log(s, d):
    """What two passes leave in a cache: a line for each distinct text."""
    docs, cache = _t(s, d, "documents").select("doc_id", "text"), models.EmbeddingCache(s, f"{shared_folder(s)}/cache-{uuid.uuid4().hex}")
    model = models.CachedEmbedder(models.MockEmbedder(DIM), cache)
    model.embed(docs.where("doc_id % 3 = 0"))
    model.embed(docs)
    return cache.lines().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_hash").alias("n_hashes"))


_ASCII = "array_to_string(list_transform(regexp_extract_all(to_json({})::VARCHAR, '(?s).'), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), '')"


@query(f"""WITH {C} SELECT chunk_id AS custom_id, sha256('{{"custom_id":"' || chunk_id || '","method":"POST","url":"/v1/embeddings","body":{{"model":"embed-small","input":' || {_ASCII.format('text')} || ',"dimensions":12}}}}') AS line FROM C""")
def batch_request_lines(s, d):
    return batch.request_lines(_c(s, d), "embed-small", {"dimensions": 12, "model": "no"}).select("custom_id", F.sha2("value", 256).alias("line"))


def _outputs(s, d) -> DataFrame:
    """Output lines as a provider writes them: a vector for labelled documents of quality 1, an error for the others."""
    lab = _t(s, d, "labels")
    good = F.format_string('{"custom_id":"%d","response":{"status_code":200,"body":{"data":[{"embedding":[0.5,%d.0],"index":0}]}}}', "doc_id", "toxic")
    bad = F.format_string('{"custom_id":"%d","response":{"status_code":500,"body":{}}}', "doc_id")
    return lab.select(F.when(F.col("quality") == 1, good).otherwise(bad).alias("value"))


@query("SELECT doc_id::VARCHAR AS custom_id, [0.5, toxic]::DOUBLE[] AS vector FROM labels WHERE quality = 1")
def batch_output_parse(s, d):
    return batch.parse_output(_outputs(s, d))


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 500)::INT AS file_no FROM documents")
def batch_file_assign(s, d):
    return batch.assign_files(_t(s, d, "documents").select("doc_id"), ["doc_id"], 500)


_CAP = 20_000


@query(f"""WITH RECURSIVE L AS (SELECT doc_id, strlen(text) AS b, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
R(i, doc_id, used, n, file_no) AS (SELECT 0, NULL::BIGINT, 0::BIGINT, 0, 0 UNION ALL
 SELECT L.i, L.doc_id, CASE WHEN n >= 30 OR used + b > {_CAP} THEN b ELSE used + b END, CASE WHEN n >= 30 OR used + b > {_CAP} THEN 1 ELSE n + 1 END, CASE WHEN n >= 30 OR used + b > {_CAP} THEN file_no + 1 ELSE file_no END
 FROM R JOIN L ON L.i = R.i + 1) SELECT doc_id, file_no FROM R WHERE doc_id IS NOT NULL""")
def batch_file_bytes(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.octet_length("text").alias("b"))
    return batch.assign_files(rows, ["doc_id"], 30, _CAP, "b").select("doc_id", "file_no")


@query(f"SELECT count(*) AS n, 0 AS n_over FROM documents WHERE strlen(text) <= {_CAP}")
def batch_file_ranges(s, d):
    """Files folded range by range keep both caps, and the order."""
    rows = _t(s, d, "documents").select("doc_id", F.octet_length("text").alias("b")).where(f"b <= {_CAP}")
    filed = written(batch.assign_files(rows, ["doc_id"], 30, _CAP, "b", ranges=True))
    each = filed.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    wrong = each.alias("x").join(each.alias("y"), F.col("x.file_no") + 1 == F.col("y.file_no")).where("x.high > y.low").count()
    over = each.where(f"n > 30 or b > {_CAP}").count() + wrong
    return filed.agg(F.count(F.lit(1)).alias("n"), F.lit(over).alias("n_over"))


class _Service:
    """A provider of batches that keeps its files beside the requests and has answered all but the first request."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, {}

    def upload(self, path: str) -> str:
        self.files[f"f{len(self.files)}"] = path
        return f"f{len(self.files) - 1}"

    def create(self, file_id: str, window: str) -> dict:
        return {"id": f"b-{file_id}", "status": "in_progress"}

    def retrieve(self, batch_id: str) -> dict:
        return {"id": batch_id, "status": "completed", "output_file_id": batch_id.removeprefix("b-")}

    def download(self, file_id: str, to: str) -> str:
        return self.download_many([file_id], to)[0]

    def download_many(self, file_ids: list[str], to: str) -> list[str]:
        from pyspark.sql import Window

        lines = self.spark.read.text([self.files[i] for i in file_ids]).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"file_no=(\d+)", 1))
        asked = lines.select("file", F.get_json_object("value", "$.custom_id").alias("id"), F.get_json_object("value", "$.body.input").alias("t"))
        asked = asked.withColumn("least", F.min("id").over(Window.partitionBy("file"))).where("id != least")
        data = F.array(F.struct(X.hash_vector(F.col("t"), 4).alias("embedding"), F.lit(0).alias("index")))
        line = F.struct(F.col("id").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(data.alias("data")).alias("body")).alias("response"))
        folder = f"{to}/{uuid.uuid4().hex}"
        asked.select("file", F.to_json(line)).write.partitionBy("file").text(folder)
        paths = [f"{folder}/file={re.search(r'file_no=(\d+)', self.files[i])[1]}" for i in file_ids]
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for path in paths:  # also where nothing was answered
            fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        return paths


def _workflow(s, d, docs: DataFrame) -> tuple:
    docs = docs.withColumn("document_id", F.col("doc_id").cast("string")).select("document_id", "text", "lang")
    chunks = chunking.chunks(docs, SIZE, OVERLAP)
    root = f"{shared_folder(s)}/batch-{uuid.uuid4().hex}"
    client = _Service(s, root)
    first = batch.BatchManager(s, batch.BatchState(root, "openai/embed", max_lines=100), store.ChunkStore(s, f"{root}/store"), client)
    first.prepare(chunks, ["document_id", "chunk_index"])
    later = batch.BatchManager.from_state(s, root, client, sleep=lambda _: None)  # another process goes on
    later.submit()
    return later, later.submit(), later.poll()


def _asked(c: str) -> str:
    return f"{c}, B AS (SELECT *, floor((row_number() OVER (ORDER BY doc_id::VARCHAR, chunk_index) - 1) / 100)::INT AS f FROM C), G AS (SELECT * FROM B QUALIFY chunk_id <> min(chunk_id) OVER (PARTITION BY f))"


@query(f"WITH {_asked(C)} SELECT chunk_id, doc_id::VARCHAR AS document_id, lang, 'openai/embed' AS embedding_model, list_transform({VEC.format(dim=4, text='text')}, lambda x: round(x, 5)) AS vector FROM G")
def batch_workflow(s, d):
    """Prepare, submit and poll against a service: what is in the store then."""
    manager, _, _ = _workflow(s, d, _t(s, d, "documents"))
    return manager.store.read().select("chunk_id", "document_id", "lang", "embedding_model", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


_ASKED = _asked(C.replace("FROM documents)", "FROM documents WHERE lang = 'fr')"))


@query(f"WITH {_ASKED} SELECT f AS file_no, 0 AS sent_again, count(*) AS added, count(*) AS events FROM G GROUP BY f".replace("count(*) AS events", "3::BIGINT AS events"))
def batch_states(s, d):
    """For each request file: batches that a second submit makes, vectors ingested, events logged."""
    manager, again, results = _workflow(s, d, _t(s, d, "documents").where("lang = 'fr'"))
    got = s.createDataFrame([(r.batch_id, r.records_added) for r in results], "batch_id string, added bigint").where("added > 0")
    file = F.regexp_extract("jsonl_path", r"file_no=(\d+)", 1).cast("int").alias("file_no")
    events = manager.events().groupBy("batch_id", file).agg(F.count(F.lit(1)).alias("events"))
    return events.join(got, "batch_id").select("file_no", F.lit(len(again)).alias("sent_again"), "added", "events")


@query("""SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.toxic = 0) AS added, count(*) FILTER (WHERE NOT (d.doc_id IS NOT NULL AND l.toxic = 0)) AS skipped
FROM labels l LEFT JOIN documents d USING (doc_id) WHERE l.quality = 1""")
def batch_ingest_counts(s, d):
    registry = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    had = _t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return batch.ingest_counts(batch.parse_output(_outputs(s, d)), registry, had)


_LAST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id"


def _latest(s, d) -> DataFrame:
    return batch.latest(_t(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), "user_id", ("ts", "event_id")).select("user_id", "event_type", "value")


@query(_LAST)
def latest_per_key(s, d):
    return _latest(s, d)


@query(f"SELECT * FROM ({_LAST}) WHERE user_id = (SELECT min(user_id) FROM events)")
def latest_one(s, d):
    e = _t(s, d, "events")
    one = e.where(F.col("user_id") == e.agg(F.min("user_id")).first()[0])
    return batch.latest(one.select("user_id", "event_type", "value", "ts", "event_id"), "user_id", ("ts", "event_id")).select("user_id", "event_type", "value")


_STATUS = {"click": "in_progress", "view": "completed", "purchase": "failed", "signup": "expired"}


@query(f"""WITH L AS ({_LAST}), S AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE 'cancelled' END AS status, value > 50 AS done FROM L)
SELECT user_id FROM S WHERE status NOT IN ('completed', 'failed', 'cancelled', 'expired') OR status IN ('completed', 'cancelled', 'expired') AND NOT done""")
def pending_batches(s, d):
    e = _t(s, d, "events")
    status = F.lit("cancelled")
    for k, v in _STATUS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    log = e.select(F.col("user_id").alias("batch_id"), status.alias("status"), F.when(F.col("value") > 50, 1).alias("ingested_at"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return batch.pending(log.select("batch_id"), log).select(F.col("batch_id").alias("user_id"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 50")
def queue_limit(s, d):
    return batch.queue(_t(s, d, "documents"), _t(s, d, "labels"), ["doc_id"], 50, "doc_id").select("doc_id")


_UNIT = "CASE event_id % 8 WHEN 0 THEN 's' WHEN 1 THEN ' m ' WHEN 2 THEN 'h' WHEN 3 THEN 'D' WHEN 4 THEN 'x' WHEN 5 THEN '' WHEN 6 THEN 's3' ELSE 'H' END"


@query(f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 7 THEN 3600 END * user_id AS seconds FROM events")
def parse_duration(s, d):
    spelled = F.concat(F.lit(" "), F.col("user_id").cast("string"), F.expr(_UNIT))
    return _t(s, d, "events").select("event_id", X.parse_duration(spelled).alias("seconds"))


# ---- sources ----


def _one_file(s, docs: DataFrame, path: str) -> None:
    """docs in the order of doc_id as one CSV file: tasks write ranges, whose bytes are put together."""
    folder, hadoop, io = f"{path}.parts", s._jvm.org.apache.hadoop.fs.Path, s._jvm.org.apache.hadoop.io.IOUtils
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(folder)
    conf = s._jsc.hadoopConfiguration()
    fs = hadoop(folder).getFileSystem(conf)
    out = fs.create(hadoop(path))
    out.write(bytearray((",".join(f'"{c}"' for c in docs.columns) + "\n").encode()))
    for part in sorted(f.getPath().toString() for f in fs.listStatus(hadoop(folder)) if f.getPath().getName().endswith(".csv")):
        came = fs.open(hadoop(part))
        io.copyBytes(came, out, 1 << 20, False)
        came.close()
    out.close()
    fs.delete(hadoop(folder), True)


def _csv(s, d, one: bool) -> str:
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    docs = _t(s, d, "documents")
    if one:
        _one_file(s, docs, f"{path}/documents.csv")
        return f"{path}/documents.csv"
    docs.write.option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(f"{path}/documents", header=True)
    return f"{path}/documents"


_STRIPPED = f"trim(text, {_WHITE})"


@query(f"SELECT doc_id::VARCHAR AS document_id, sha256({_STRIPPED}) AS text_hash, lang, source FROM documents WHERE {_STRIPPED} <> ''")
def scan_documents(s, d):
    docs = files.read_csv(s, _csv(s, d, False), "text", ["lang", "source", "no_such"], "doc_id", schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("document_id", X.text_hash(F.col("text")).alias("text_hash"), "lang", "source")


@query(f"""WITH R AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT 'documents_' || i AS document_id, 'documents.csv:row_' || i AS source_path, sha256({_STRIPPED}) AS text_hash FROM R WHERE {_STRIPPED} <> ''""")
def document_ids(s, d):
    docs = files.read_csv(s, _csv(s, d, True), "text", schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("document_id", "source_path", X.text_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang FROM documents ORDER BY documents.doc_id LIMIT 12")
def preview_limit(s, d):
    return files.preview(s, _csv(s, d, True)).select("doc_id", "lang")


@query(f"""WITH R AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT 'lang-' || lang || '_' || i AS document_id, 'lang-' || lang || '.csv:row_' || i AS source_path, n_chars FROM R WHERE {_STRIPPED} <> ''""")
def document_ids_of_folder(s, d):
    """A folder of CSV files without line breaks inside rows: rows are numbered in each file, whatever its splits."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    docs = _t(s, d, "documents").withColumn("text", F.regexp_replace("text", r"[\r\n]", " "))
    for (lang,) in docs.select("lang").distinct().collect():
        _one_file(s, docs.where(F.col("lang") == lang), f"{path}/lang-{lang}.csv")
    got = files.read_csv(s, path, "text", ["n_chars"], schema="doc_id bigint, text string, lang string, source string, n_chars bigint", multi_line=False)
    return got.select("document_id", "source_path", "n_chars")


@query(f"SELECT 'd' || doc_id AS document_id, sha256({_STRIPPED}) AS text_hash, 'd' || doc_id || '.txt' AS filename, 'txt' AS source FROM documents WHERE lang = 'de' AND {_STRIPPED} <> ''")
def scan_text_folder(s, d):
    path = f"{shared_folder(s)}/txt-{uuid.uuid4().hex}"
    s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration()).mkdirs(s._jvm.org.apache.hadoop.fs.Path(path))

    def put(batches):
        """One file for each row, written by the tasks."""
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                with system.open_output_stream(f"{folder}/d{doc}.txt") as out:
                    out.write(f"\u00a0 {text}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    _t(s, d, "documents").where("lang = 'de' and text is not null").select("doc_id", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    docs = files.ingest(s, path, "txt")
    return docs.select("document_id", X.text_hash(F.col("text")).alias("text_hash"), "filename", "source")


@query(f"WITH {C} SELECT chunk_id, doc_id AS document_id, lang, chunk_index FROM C")
def stream_index(s, d):
    """Documents as a stream of files, added to a store; a second run over the same files adds nothing."""
    docs = _t(s, d, "documents").withColumnRenamed("doc_id", "document_id").select("document_id", "text", "lang")
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    n = max(3, docs._jdf.queryExecution().toRdd().getNumPartitions())  # files, each of which one task writes: as many as the table's splits
    docs.repartition(n).write.parquet(f"{folder}/in")
    kept = store.ChunkStore(s, f"{folder}/store")
    for run in range(2):
        came = streaming.stream_documents(s, f"{folder}/in", "document_id bigint, text string, lang string", files_per_trigger=-(-2 * n // 3))
        pieces = chunking.chunks(came, SIZE, OVERLAP, meta=["lang"])
        streaming.index_stream(pieces, models.MockEmbedder(DIM), kept, ["lang"], f"{folder}/checkpoint{run}").awaitTermination()
    return kept.read().select("chunk_id", "document_id", "lang", "chunk_index")
