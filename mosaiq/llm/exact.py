"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Sorting gives each distinct block an integer name; then
adjacent names are paired and the pairs named by sorting, again and again, until one name stands for the whole
document. Names come from comparing contents, never from trusting a hash: hashing spreads the sorts over tasks and
brings names back to where blocks occur, once the distinct contents have shown that no two of them share their hashes
(those that do are named by content). A name is (bucket, rank inside the bucket), a function of the contents alone,
so a task that is run again after a loss gives the same ones. Distinct contents are found with map-side combine, so a
block that a third of all documents have is sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.session import written

BLOCK = 4096  # bytes
_BUCKET_BITS = 30  # a name is bucket << 33 | rank: 2^33 distinct contents fit in each of 2^30 buckets


def _hashes(col: str) -> list[Column]:
    return [F.xxhash64(col), F.xxhash64(F.lit(5), col)]


def _named(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """distinct, the rows of cols without repetition, with mq_name: an integer for each, in sorted order inside a bucket."""
    bucket = F.xxhash64(*cols).bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    return distinct.withColumn("mq_name", F.shiftleft(bucket, 33) + F.dense_rank().over(Window.partitionBy(bucket).orderBy(*cols)))


def _block_names(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mq_name) of the rows (keys, mq_block): equal contents get equal names, others others."""
    first, second = _hashes("mq_block")
    hashed = blocks.withColumns({"mq_h1": first, "mq_h2": second})
    distinct = hashed.select("mq_h1", "mq_h2", "mq_block").distinct()
    counted = written(distinct.groupBy("mq_h1", "mq_h2").agg(F.count(F.lit(1)).alias("mq_n")))
    clash = counted.where("mq_n > 1").select("mq_h1", "mq_h2")
    once = counted.where("mq_n = 1").select("mq_h1", "mq_h2", F.lit(0).alias("mq_r"))
    if clash.isEmpty():
        names = _named(once, ["mq_h1", "mq_h2", "mq_r"])
        return hashed.select(*keys, "mq_h1", "mq_h2").join(names, ["mq_h1", "mq_h2"]).select(*keys, "mq_name")
    rank = F.row_number().over(Window.partitionBy("mq_h1", "mq_h2").orderBy("mq_block"))
    several = distinct.join(clash, ["mq_h1", "mq_h2"], "left_semi").withColumn("mq_r", rank)
    names = written(_named(once.unionByName(several.select("mq_h1", "mq_h2", "mq_r")), ["mq_h1", "mq_h2", "mq_r"]))
    plain = hashed.select(*keys, "mq_h1", "mq_h2").join(names.where("mq_r = 0"), ["mq_h1", "mq_h2"])
    by_content = hashed.join(several, ["mq_h1", "mq_h2", "mq_block"]).join(names, ["mq_h1", "mq_h2", "mq_r"])
    return plain.select(*keys, "mq_name").unionByName(by_content.select(*keys, "mq_name"))


def address(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(mq_id, mq_len, mq_hash): where a row's result belongs. Rows that agree in it are rows repeated."""
    return docs.select(F.col(id_col).alias("mq_id"), *_address(text_col), F.col(text_col).cast("binary").alias("mq_bytes"))


def _address(text_col: str) -> list[Column]:
    return [F.octet_length(text_col).cast("bigint").alias("mq_len"), F.xxhash64(text_col).alias("mq_hash")]


_TIMES = 1 << 16


def each_time(rows: DataFrame, times: str, first: str) -> DataFrame:
    """Each row as many times as its column times says; first: whether it is the row's first time. No array that is
    made on the way is longer than 65,536, for up to 2^32 times."""
    n = F.col(times)
    many = rows.withColumn("mq_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / _TIMES).cast("bigint"))))
    size = F.least(F.lit(_TIMES).cast("bigint"), n - F.col("mq_b") * _TIMES)
    return many.withColumn("mq_i", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).withColumn(first, (F.col("mq_b") == 0) & (F.col("mq_i") == 1)).drop("mq_b", "mq_i")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(mq_id, mq_len, mq_hash, mq_rows, mq_blocks, mq_name) for each distinct id and non-null text.

    Two documents have the same (mq_blocks, mq_name) just if their texts are equal.
    """
    rows = address(docs, id_col, text_col).where("mq_bytes is not null")
    last = F.greatest(F.ceil(F.col("mq_len") / block) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("mq_bytes"), i * block + 1, F.lit(block)))
    blocks = rows.select("mq_id", "mq_len", "mq_hash", F.posexplode(cut).alias("mq_pos", "mq_block"))
    named = _block_names(blocks, ["mq_id", "mq_len", "mq_hash", "mq_pos"])
    done = []
    todo = written(
        named.groupBy("mq_id", "mq_len", "mq_hash").agg(
            F.count(F.when(F.col("mq_pos") == 0, 1)).alias("mq_rows"),
            F.transform(F.array_sort(F.collect_set(F.struct("mq_pos", "mq_name"))), lambda x: x["mq_name"]).alias("mq_names"),
        )
    )
    todo = todo.withColumn("mq_blocks", F.size("mq_names"))
    longest = todo.agg(F.max("mq_blocks")).first()[0] or 0
    keys = ["mq_id", "mq_len", "mq_hash", "mq_rows", "mq_blocks"]
    while longest > 1:
        done.append(todo.where(F.size("mq_names") == 1).select(*keys, F.col("mq_names")[0].alias("mq_name")))
        n = F.size("mq_names")
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("mq_names", i * 2).alias("l"), F.coalesce(F.get("mq_names", i * 2 + 1), F.lit(-1)).alias("r")),
        )
        paired = todo.where(n > 1).select(*keys, F.posexplode(pairs).alias("mq_pos", "mq_pair")).select(*keys, "mq_pos", "mq_pair.l", "mq_pair.r")
        renamed = paired.join(_named(paired.select("l", "r").distinct(), ["l", "r"]), ["l", "r"])
        todo = written(renamed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("mq_pos", "mq_name"))), lambda x: x["mq_name"]).alias("mq_names")))
        longest = (longest + 1) // 2
    out = todo.select(*keys, F.col("mq_names")[0].alias("mq_name"))
    for part in done:
        out = out.unionByName(part)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """identities with first_id and n_copies."""
    named = written(identities(docs, id_col, text_col, block))
    groups = named.groupBy("mq_blocks", "mq_name").agg(F.min("mq_id").alias("first_id"), F.sum("mq_rows").alias("n_copies"))
    return named.join(groups, ["mq_blocks", "mq_name"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, first_id, n_copies, is_duplicate), one row for each row of docs.

    first_id is the smallest id among the rows with the same text, n_copies their number; is_duplicate says that
    another row stays instead. A null text equals no other: its row has itself as first_id, one copy. The empty text
    is a text like any other. A null id counts as larger than all others. Of rows repeated (same id and text) one
    stays. Other columns are not read. An empty table gives an empty result.
    """
    named = _grouped(docs, id_col, text_col, block)
    each = each_time(named, "mq_rows", "mq_once")
    kept = F.col("mq_id").eqNullSafe(F.col("first_id")) & F.col("mq_once")
    nulls = docs.where(F.col(text_col).isNull()).select(F.col(id_col), F.col(id_col).alias("first_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(False).alias("is_duplicate"))
    return each.select(F.col("mq_id").alias(id_col), "first_id", "n_copies", (~kept).alias("is_duplicate")).unionByName(nulls)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the rows that exact_groups calls duplicates; all columns stay as they are. Of rows repeated (same id
    and text) that stay, one stays, whatever their other columns. Null texts, null ids and empty tables are as there."""
    named, first = _grouped(docs, id_col, text_col, block), F.col("mq_id").eqNullSafe(F.col("first_id"))
    marks = written(named.where(~first | (F.col("mq_rows") > 1)).select("mq_id", "mq_len", "mq_hash", first.alias("mq_again")))
    return without(docs, marks, id_col, text_col)


def without(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs but for the rows whose address is in marks; where mq_again is true, one of the rows repeated stays."""
    marks = marks.hint("merge")  # the plan that large tables need, at any size
    if marks.where("mq_again").isEmpty():
        return docs.join(marks, at_address(docs, marks, id_col, text_col), "left_anti")
    plain = docs.join(marks, at_address(docs, marks, id_col, text_col), "left_anti")
    more = marks.where("mq_again")
    repeated = docs.join(more, at_address(docs, more, id_col, text_col), "left_semi")
    names = [f"mq_{i}" for i in range(len(docs.columns))]
    keyed = repeated.toDF(*names).withColumns({"mq_len": F.octet_length(names[docs.columns.index(text_col)]), "mq_hash": F.xxhash64(names[docs.columns.index(text_col)])})
    one = keyed.dropDuplicates([names[docs.columns.index(id_col)], "mq_len", "mq_hash"]).select(*names).toDF(*docs.columns)
    return plain.unionByName(one)


def at_address(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> Column:
    """Join condition of docs with a table that carries addresses."""
    length, content = F.octet_length(docs[text_col]).cast("bigint"), F.xxhash64(docs[text_col])
    return docs[id_col].eqNullSafe(marks["mq_id"]) & (length == marks["mq_len"]) & (content == marks["mq_hash"])


ORACLE = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END::BIGINT AS n_copies,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents"""
