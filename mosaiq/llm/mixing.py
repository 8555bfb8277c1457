"""Mixing sources to target weights by pivotal dependent rounding.

Each document is due a fractional number of copies, the same for all of a source: target size over present size.
Whole parts are certain. The fractional parts are rounded together: two open documents meet, and mass moves at
random from one to the other until one of them is at 0 or 1 (the expected value of each stays as it was). Groups of
documents are reduced this way to one open document each, groups of groups next, up a tree that ends at the source
and then the corpus; so the number of copies of a source, and of any subtree, is off its expected value by less
than one. Groups and random draws come from hashes of the rows, so a task that is run again decides alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.exact import _address, each_time
from mosaiq.session import written

LEAF = 16_384  # documents that a leaf of the tree reduces, on average
FAN = 1024  # children of an inner node
_EPS = 1e-9
_ROW = "mq_id {id}, mq_source {source}, mq_len bigint, mq_hash bigint, mq_rows bigint, mq_due double, mq_copies bigint, mq_p double, mq_h bigint, mq_bucket bigint, mq_buckets bigint"


def _uniform(h: np.ndarray, level: int) -> np.ndarray:
    """Draws in (0, 1) from the rows' hashes (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def pivot(p: list[float], u: list[float]) -> list[float]:
    """One pass of pivotal rounding: all but at most one of the result are 0 or 1, the sum is kept."""
    p = list(p)
    held = -1
    for i, b in enumerate(p):
        if not _EPS < b < 1 - _EPS:
            p[i] = float(round(b))
            continue
        if held < 0:
            held = i
            continue
        a = p[held]
        s = a + b
        if s < 1:
            first = u[i] * s < a  # the first takes all
            p[held], p[i] = (s, 0.0) if first else (0.0, s)
        else:
            first = u[i] * (2 - s) < 1 - b  # the first becomes whole
            p[held], p[i] = (1.0, s - 1) if first else (s - 1, 1.0)
        for j in (held, i):
            if not _EPS < p[j] < 1 - _EPS:
                p[j] = float(round(p[j]))
        held = next((j for j in (held, i) if 0 < p[j] < 1), -1)
    return p


def _reduce(level: int, last: bool):
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mq_h", "mq_hash", "mq_len"], kind="stable").reset_index(drop=True)
        u = _uniform(pdf["mq_h"].to_numpy(np.int64), level)
        p = pivot(pdf["mq_p"].tolist(), u.tolist())
        if last:  # what is open at the root has a whole sum only if the corpus has
            p = [float(v < x) if 0 < x < 1 else x for x, v in zip(p, _uniform(pdf["mq_h"].to_numpy(np.int64), level + 1))]
        return pdf.assign(mq_p=p)

    return reduce


def expected_copies(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total_bytes: float | None, source_col: str, text_col: str) -> DataFrame:
    """(mq_source, mq_due, mq_n): copies that are due to each document of a source, and the source's documents."""
    spark = docs.sparkSession
    stats = docs.groupBy(F.col(source_col).alias("mq_source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("double")).alias("mq_bytes"), F.count(F.lit(1)).alias("mq_n")
    )
    if weights is None:
        stats = stats.withColumn("mq_w", F.when(F.col("mq_bytes") > 0, F.pow("mq_bytes", F.lit(temperature))).otherwise(0.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "mq_k string, mq_w double")
        stats = stats.join(given, stats["mq_source"].cast("string").eqNullSafe(given["mq_k"]), "left").select("mq_source", "mq_bytes", "mq_n", F.coalesce("mq_w", F.lit(0.0)).alias("mq_w"))
    stats = written(stats)
    sums = stats.agg(F.sum("mq_w").alias("mq_all"), F.max(F.when(F.col("mq_w") > 0, F.col("mq_bytes") / F.col("mq_w"))).alias("mq_ratio")).first()
    if not sums["mq_all"]:
        return stats.select("mq_source", F.lit(0.0).alias("mq_due"), "mq_n")
    per_weight = total_bytes / sums["mq_all"] if total_bytes is not None else sums["mq_ratio"]
    due = F.when(F.col("mq_bytes") > 0, F.lit(float(per_weight)) * F.col("mq_w") / F.col("mq_bytes")).otherwise(F.when(F.lit(weights is None), 1.0).otherwise(F.signum("mq_w")))
    return stats.select("mq_source", due.alias("mq_due"), "mq_n")


def _decided(docs, weights, temperature, total_bytes, seed, leaf, fan, id_col, source_col, text_col) -> DataFrame:
    due = expected_copies(docs, weights, temperature, total_bytes, source_col, text_col)
    length, content = _address(text_col)
    rows = docs.select(F.col(id_col).alias("mq_id"), F.col(source_col).alias("mq_doc_source"), length, content)
    rows = rows.groupBy("mq_id", "mq_doc_source", "mq_len", "mq_hash").agg(F.count(F.lit(1)).alias("mq_rows"))
    owed = F.col("mq_due") * F.col("mq_rows")
    rows = rows.join(due, rows["mq_doc_source"].eqNullSafe(due["mq_source"])).select(
        "mq_id", F.col("mq_doc_source").alias("mq_source"), F.coalesce("mq_len", F.lit(-1).cast("bigint")).alias("mq_len"), "mq_hash", "mq_rows", "mq_due",
        F.floor(owed + _EPS).alias("mq_copies"),
        F.greatest(owed - F.floor(owed + _EPS), F.lit(0.0)).alias("mq_p"),
        F.xxhash64(F.lit(seed), "mq_id", "mq_hash").alias("mq_h"),
        F.ceil(F.col("mq_n") / leaf).cast("bigint").alias("mq_buckets"),
    )
    rows = rows.withColumn("mq_bucket", F.pmod("mq_h", "mq_buckets"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = _ROW.format(id=kinds["mq_id"], source=kinds["mq_source"])
    order = [x.split()[0] for x in schema.split(", ")]
    rows = rows.select(*order)
    open_ = (F.col("mq_p") > _EPS) & (F.col("mq_p") < 1 - _EPS)
    done = [rows.where(~open_)]
    todo, level = rows.where(open_), 0
    while True:
        step = written(todo.groupBy("mq_source", "mq_bucket").applyInPandas(_reduce(level, False), schema))
        done.append(step.where(~open_))
        todo = step.where(open_)
        most = todo.agg(F.max("mq_buckets")).first()[0]
        level += 1
        if most is None:
            break
        if most == 1:
            done.append(written(todo.groupBy("mq_bucket").applyInPandas(_reduce(level, True), schema)))
            break
        todo = todo.withColumns({"mq_bucket": F.floor(F.col("mq_bucket") / fan), "mq_buckets": F.ceil(F.col("mq_buckets") / fan)})
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("mq_copies", F.col("mq_copies") + F.round("mq_p").cast("bigint"))


def mix_copies(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total_bytes: float | None = None, seed: int = 17, leaf: int = LEAF, fan: int = FAN, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, expected, copies), one row for each row of docs.

    weights: share of the output's bytes for each source, in any unit; a source without one is due no copies. None:
    size to the power of temperature. total_bytes: bytes of the output; None: the least for which no source is due
    less than one copy of each document, so nothing is lost. A null source is a source. Null and empty texts weigh
    nothing and are due what their source is due; a source that has no bytes at all is due one copy. Rows repeated
    share the copies that they are due together, as evenly as whole numbers can. A null id is an id. Other columns are
    not read. An empty table gives an empty result.
    """
    out = _decided(docs, weights, temperature, total_bytes, seed, leaf, fan, id_col, source_col, text_col)
    each, more = F.floor(F.col("mq_copies") / F.col("mq_rows")), F.col("mq_copies") % F.col("mq_rows")
    shares = F.array(F.struct((each + 1).alias("copies"), more.alias("mq_times")), F.struct(each.alias("copies"), (F.col("mq_rows") - more).alias("mq_times")))
    rows = each_time(out.select("mq_id", "mq_source", "mq_due", F.inline(shares)).where("mq_times > 0"), "mq_times", "mq_first")
    return rows.select(F.col("mq_id").alias(id_col), F.col("mq_source").alias(source_col), F.col("mq_due").alias("expected"), "copies")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total_bytes: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as many times as mix_copies gives it; the columns stay as they are, whatever their names.

    Rows with the same id, source and text share their copies, as evenly as whole numbers can; which of them, where
    other columns differ, gets one more is settled by a hash of all columns. Nulls in any column, empty texts and an
    empty table are as in mix_copies.
    """
    out = _decided(docs, weights, temperature, total_bytes, seed, LEAF, FAN, id_col, source_col, text_col)
    copies = written(out.select("mq_id", "mq_source", F.nullif(F.col("mq_len"), F.lit(-1)).alias("mq_len"), "mq_hash", "mq_copies", "mq_rows"))
    names = [f"mq_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    ident, source, text = (plain[names[docs.columns.index(c)]] for c in (id_col, source_col, text_col))
    same = ident.eqNullSafe(copies["mq_id"]) & F.octet_length(text).cast("bigint").eqNullSafe(copies["mq_len"]) & (F.xxhash64(text) == copies["mq_hash"]) & source.eqNullSafe(copies["mq_source"])
    joined = plain.join(copies.hint("shuffle_hash"), same).where("mq_copies > 0")
    single = each_time(joined.where("mq_rows = 1").select(*names, "mq_copies"), "mq_copies", "mq_first").select(*names).toDF(*docs.columns)
    if copies.where("mq_rows > 1").isEmpty():
        return single
    # rows that agree in all columns are counted; of m rows that share copies, the first copies % m get one more
    address = ["mq_id", "mq_source", "mq_len", "mq_hash", "mq_copies", "mq_rows"]
    alike = joined.where("mq_rows > 1").groupBy(*names, *address).agg(F.count(F.lit(1)).alias("mq_m"))
    upto = F.sum("mq_m").over(Window.partitionBy(*address).orderBy(F.xxhash64(*names)).rowsBetween(Window.unboundedPreceding, 0))
    rank, more = F.col("mq_upto") - F.col("mq_m"), F.col("mq_copies") % F.col("mq_rows")
    extra = F.greatest(F.least("mq_upto", more) - rank, F.lit(0))
    several = alike.withColumn("mq_upto", upto).withColumn("mq_times", F.floor(F.col("mq_copies") / F.col("mq_rows")) * F.col("mq_m") + extra)
    several = each_time(several.where("mq_times > 0").select(*names, "mq_times"), "mq_times", "mq_first")
    return single.unionByName(several.select(*names).toDF(*docs.columns))
