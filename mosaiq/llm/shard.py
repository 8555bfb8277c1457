"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided.

Ranges are cut again and again, each into at most FAN parts, until they fit; so a sample that is ordered in one task,
and the boundaries that a row is compared with, are bounded however large the table. Boundaries are joined on the range
that they cut, not broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.session import written

TARGET = 32 << 20  # bytes of text in a shard
OVERSAMPLE = 16  # samples drawn for each shard, on average
SLACK = 1.25  # a range above SLACK x target is overfull
FAN = 256  # parts that a range is cut into at a time, at most
_WIDE = 16  # boundaries in a bundle: a row is compared with the bundles' first ones, then inside one


def _key(keys: list[str]) -> Column:
    """Keys and tie as one value; null comes before all values."""
    return F.struct(*keys, "mq_tie")


def _splitters(rows: DataFrame, keys: list[str], target: float, oversample: int, fan: int) -> DataFrame:
    """(mq_range, mq_cuts): for each range the sampled keys at which the weight passes multiples of its step, in bundles.

    A row is drawn with a chance in proportion to its size; a drawn row stands for size / chance bytes. A range is
    cut into ceil(size / target) steps, fan at most. The cumulative weights run over the sample alone.
    """
    per = Window.partitionBy("mq_range")
    sums = rows.groupBy("mq_range").agg(F.sum("mq_size").alias("mq_total"))
    sums = sums.withColumn("mq_steps", F.least(F.greatest(F.ceil(F.col("mq_total") / target), F.lit(1)), F.lit(fan)).cast("double"))
    wanted = rows.join(sums, "mq_range").withColumn("mq_chance", F.least(F.lit(1.0), F.col("mq_size").cast("double") * float(oversample) * F.col("mq_steps") / F.greatest("mq_total", F.lit(1))))
    draw = (F.xxhash64(F.lit(oversample), "mq_tie").bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    drawn = wanted.where((F.col("mq_size") > 0) & (draw < F.col("mq_chance"))).withColumn("mq_weight", F.col("mq_size") / F.col("mq_chance"))
    drawn = drawn.groupBy("mq_range", "mq_steps", *keys, "mq_tie").agg(F.sum("mq_weight").alias("mq_weight"))
    ordered = per.orderBy(*[F.col(k).asc_nulls_first() for k in keys], "mq_tie")
    cum = drawn.withColumn("mq_upto", F.sum("mq_weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("mq_of", F.sum("mq_weight").over(per))
    share = F.col("mq_steps")
    cum = cum.withColumn("mq_step", F.floor(F.col("mq_upto") * share / F.col("mq_of") - 1e-9)).withColumn("mq_before", F.lag("mq_step", 1, 0).over(ordered))
    passed = F.col("mq_step") > F.col("mq_before")
    large = passed & (F.col("mq_weight") * share >= F.col("mq_of") / 2)  # a large row ends its range
    cum = cum.withColumn("mq_cut", passed | F.coalesce(F.lag(large, 1).over(ordered), F.lit(False)))
    cuts = cum.where("mq_cut").groupBy("mq_range").agg(F.array_sort(F.collect_list(_key(keys))).alias("mq_all"))
    bundles = F.transform(F.sequence(F.lit(0), F.ceil(F.size("mq_all") / F.lit(_WIDE)).cast("int") - 1), lambda i: F.slice("mq_all", i * _WIDE + 1, F.lit(_WIDE)))
    return cuts.select("mq_range", bundles.alias("mq_cuts"))


def _assign(rows: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Each range of cuts becomes its sub-ranges, in order, by four digits more. A row at a boundary goes above it."""
    names, key = rows.columns, _key(keys)
    joined = rows.join(cuts, "mq_range", "left")
    bundle = F.when(F.col("mq_cuts").isNull(), 0).otherwise(F.size(F.filter("mq_cuts", lambda b: b[0] <= key)))
    joined = joined.withColumn("mq_bundle", bundle)
    inside = F.size(F.filter(F.get("mq_cuts", F.col("mq_bundle") - 1), lambda c: c <= key))
    place = F.when(F.col("mq_bundle") > 0, (F.col("mq_bundle") - 1) * _WIDE + inside).otherwise(0)
    digits = F.when(F.col("mq_over"), F.lpad(place.cast("string"), 4, "0")).otherwise("")
    return joined.withColumn("mq_range", F.concat("mq_range", digits)).select(*names)


def _keyed(docs: DataFrame, keys: tuple[str, ...], id_col: str, text_col: str, more: list[Column]) -> DataFrame:
    """The columns of more with what decides a row's shard."""
    cols = [F.col(k).alias(f"mq_k{i}") for i, k in enumerate(keys)]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(*more, F.lit("").alias("mq_range"), *cols, F.xxhash64(id_col, text_col).alias("mq_tie"), size.alias("mq_size"))
    return rows.withColumn("mq_row", F.monotonically_increasing_id())


def _plan(rows: DataFrame, keys: list[str], target: int, oversample: int, slack: float, fan: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(boundaries of each round, ranges whose rows are dealt out, (mq_range, shard)) for rows, a table with keys and sizes."""
    levels, dealt, ranges, todo = [], [], [], rows
    while True:
        alike = F.when(F.col("mq_size") > 0, F.xxhash64(*keys, "mq_tie"))  # rows without bytes can't be cut from, nor need they
        by = written(todo.groupBy("mq_range").agg(F.sum("mq_size").alias("mq_total"), F.max("mq_size").alias("mq_most"), F.coalesce(F.min(alike) < F.max(alike), F.lit(False)).alias("mq_many")))
        large = F.col("mq_total") > slack * target
        # one text over and over: its rows are all alike, so any of them may go to any of its shards
        parts = F.when(large & (F.col("mq_total") > F.col("mq_most")), F.ceil(F.col("mq_total") / target)).otherwise(1).cast("bigint")
        done = by.where(~large | ~F.col("mq_many")).select("mq_range", parts.alias("mq_parts"))
        ranges.append(done)
        dealt.append(done.where("mq_parts > 1"))
        over = by.where(large & F.col("mq_many")).select("mq_range", F.lit(True).alias("mq_over"))
        if over.isEmpty():
            break
        rest = todo.join(over.select("mq_range"), "mq_range", "left_semi")
        levels.append(written(over.join(_splitters(rest, keys, target, oversample, fan), "mq_range", "left")))
        todo = written(_assign(rest, levels[-1], keys))
        oversample *= 2
    all_ranges, all_dealt = ranges[0], dealt[0]
    for r, d in zip(ranges[1:], dealt[1:]):
        all_ranges, all_dealt = all_ranges.unionByName(r), all_dealt.unionByName(d)
    names = all_ranges.withColumn("mq_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mq_parts") - 1)))
    names = names.select(F.when(F.col("mq_parts") > 1, F.concat("mq_range", _dealt_to("mq_i"))).otherwise(F.col("mq_range")).alias("mq_range"))
    # only the ranges, one row each, are ranked in one task
    return levels, written(all_dealt), written(names.select("mq_range", (F.row_number().over(Window.orderBy("mq_range")) - 1).alias("shard")))


def _dealt_to(number: str) -> Column:
    return F.lpad(F.col(number).cast("string"), 16, "0")


def _routed(rows: DataFrame, levels: list[DataFrame], dealt: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their last range. Boundaries are joined on ranges, by the plan that their size calls for."""
    for cuts in levels:
        rows = _assign(rows, cuts, keys)
    names = rows.columns
    rows = rows.join(dealt, "mq_range", "left").withColumn("mq_i", F.pmod("mq_row", "mq_parts"))
    return rows.withColumn("mq_range", F.when(F.col("mq_parts").isNotNull(), F.concat("mq_range", _dealt_to("mq_i"))).otherwise(F.col("mq_range"))).select(*names)


def shard_ids(docs: DataFrame, target_bytes: int = TARGET, oversample: int = OVERSAMPLE, slack: float = SLACK, keys: tuple[str, ...] = ("source", "doc_id"), id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """(id, shard, n_bytes), one row for each row of docs.

    Shards are ranges of keys, in order: all rows of shard i come before those of shard i + 1; rows with equal keys
    are ordered by a hash of id and text. Boundaries are quantiles of a size-weighted sample whose size follows the
    number of shards. A range above slack x target_bytes is sampled anew, more densely, and subdivided, until it
    fits or holds just one (keys, id, text); if that is of rows repeated, they are dealt out evenly to as many shards
    as they need, so only a single row above that size stays overfull. Nulls come first in a key; null and empty texts
    have no bytes. Other columns are not read. An empty table gives an empty result.
    """
    cols = [f"mq_k{i}" for i in range(len(keys))]
    rows = written(_keyed(docs, keys, id_col, text_col, [F.col(id_col).alias("mq_id")]))
    levels, dealt, ranked = _plan(rows, cols, target_bytes, oversample, slack, fan)
    return _routed(rows, levels, dealt, cols).join(ranked, "mq_range").select(F.col("mq_id").alias(id_col), "shard", F.col("mq_size").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, target_bytes: int = TARGET, oversample: int = OVERSAMPLE, slack: float = SLACK, keys: tuple[str, ...] = ("source", "doc_id"), id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> str:
    """Range-partition the records: docs as Parquet under path, one folder for each shard of shard_ids, all columns as
    they are, each row once. The name of the folders' column, which is given back, is shard, or mq_shard where docs
    has a column of that name. Rows repeated (same keys, id and text) that fill several shards are dealt out to these.
    Nulls and empty texts are as in shard_ids; an empty table writes no shard. Texts travel once, to their shards."""
    cols, name = [f"mq_k{i}" for i in range(len(keys))], "mq_shard" if "shard" in docs.columns else "shard"
    sizes = written(_keyed(docs, keys, id_col, text_col, []))
    levels, dealt, ranked = _plan(sizes, cols, target_bytes, oversample, slack, fan)
    names = [f"mq_c{i}" for i in range(len(docs.columns))]
    rows = _keyed(docs, keys, id_col, text_col, [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    routed = _routed(rows, levels, dealt, cols).repartition("mq_range").join(ranked, "mq_range")
    out = routed.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], F.col("shard").alias(name))
    out.write.partitionBy(name).parquet(path)
    return name


def sharded(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, shard, n_bytes) of docs as write_shards wrote them under path."""
    name = write_shards(docs, path, **options)
    read = docs.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{name}` int").parquet(path)
    return read.select("doc_id", F.col(name).alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
