"""Cells: the distinct combinations of metadata values, and chunks in them."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.text import py_str


def cell_id(df: DataFrame, fields: list[str]) -> Column:
    """name=value of the fields, by name, joined by |; null is spelled None."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.coalesce(py_str(df[f"`{f}`"], df.schema[f].dataType), F.lit("None"))) for f in sorted(fields)])


def cell_label(df: DataFrame, fields: list[str]) -> Column:
    """name=value joined by ' | ' for display; All data where there are no fields."""
    if not fields:
        return F.lit("All data")
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{f}="), F.coalesce(py_str(df[f"`{f}`"], df.schema[f].dataType), F.lit("None"))) for f in sorted(fields)])


def present(fields: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{f}`").isNotNull() for f in fields], F.lit(True))


def construct_cells(chunks: DataFrame, fields: list[str], seq: list[str] | None = None, include_null_cells: bool = False) -> DataFrame:
    """(cell_id, *fields): one row for each combination; rows where a field is null are left out unless asked for.

    seq: columns whose least value gives first_seen, the cells' order of appearance.
    """
    if not fields:
        raise ValueError("cell fields must be given")
    missing = [f for f in fields if f not in chunks.columns]
    if missing:
        raise ValueError(f"no such metadata: {', '.join(missing)}")
    rows = chunks if include_null_cells else chunks.where(present(fields))
    grouped = rows.groupBy(*fields).agg(*([F.min(F.struct(*seq)).alias("first_seen")] if seq else [F.count(F.lit(1)).alias("mq_n")]))
    return grouped.select(cell_id(grouped, fields).alias("cell_id"), *fields, *(["first_seen"] if seq else []))


def chunks_for_cell(chunks: DataFrame, cell: dict[str, Any]) -> DataFrame:
    """The chunks whose fields equal the cell's; a null in the cell matches null, and a column that isn't there."""
    parts = []
    for f, v in cell.items():
        parts.append(F.lit(v is None) if f not in chunks.columns else chunks[f"`{f}`"].isNull() if v is None else chunks[f"`{f}`"] == F.lit(v))
    return chunks.where(reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), parts, F.lit(True)))


def chunks_dataframe(chunks: DataFrame, meta: list[str]) -> DataFrame:
    return chunks.select("chunk_id", "document_id", "text", "chunk_index", "start_char", "end_char", *meta)


def unique_values(df: DataFrame, field: str) -> DataFrame:
    """(value, ord): distinct non-null values in the order of their spelling, ord from 1."""
    spelled = py_str(F.col("value"), df.schema[field].dataType)
    values = df.select(F.col(f"`{field}`").alias("value")).where("value is not null").distinct()
    return values.withColumn("ord", F.row_number().over(Window.orderBy(spelled)))


def list_metadata_values(df: DataFrame, fields: list[str], json_col: str | None = None) -> DataFrame:
    """(field, values): sorted distinct values as text of each field; a field without a column is looked up in json_col."""
    def value(f: str) -> Column:
        if f in df.columns:
            return py_str(df[f"`{f}`"], df.schema[f].dataType)
        if not json_col:
            return F.lit(None).cast("string")
        return F.get_json_object(F.col(json_col), f"$.{f}")

    pairs = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    rows = df.select(F.inline(pairs))
    return rows.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values"))


def metadata_fields(df: DataFrame, json_col: str) -> DataFrame:
    """Sorted union of the keys of a JSON column."""
    return df.select(F.explode(F.json_object_keys(json_col)).alias("field")).distinct().orderBy("field")


def _json_value(c: Column, kind: T.DataType) -> Column:
    """c for JSON: keys of objects in order, bytes as text, numbers that are not finite as null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_json_value(c[f.name], f.dataType).alias(f.name) for f in fields])) if fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _json_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _json_value(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return c


def metadata_json(df: DataFrame, fields: list[str]) -> Column:
    """JSON of the fields, sorted by name at every depth, nulls kept, numbers that are not finite as null, bytes as text."""
    cols = [_json_value(df[f"`{f}`"], df.schema[f].dataType).alias(f) for f in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit("{}")


def metadata_kinds(df: DataFrame, fields: list[str]) -> list[tuple[str, str]]:
    """(field, kind) with kinds bool, int, float, string as the store widens them."""
    kinds = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float"}
    return [(f, kinds.get(df.schema[f].dataType.simpleString(), "string")) for f in sorted(fields)]


def inferred_kind(c: Column) -> Column:
    """Aggregate: the narrowest of bool, int, float, string that all non-null values of a text column can be read as."""
    all_of = lambda cond: F.coalesce(F.bool_and(F.when(c.isNotNull(), cond)), F.lit(False))
    return (
        F.when(F.count(c) == 0, "string")
        .when(all_of(F.lower(c).isin("true", "false")), "bool")
        .when(all_of(c.try_cast("bigint").isNotNull()), "int")
        .when(all_of(c.try_cast("double").isNotNull()), "float")
        .otherwise("string")
    )
