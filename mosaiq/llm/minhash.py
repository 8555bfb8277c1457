"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of M half keys, each of K minhashes, are computed for a document. A table's key combines
half key i of the first collection with half key j of the second: M * M tables of 2K minhashes from 2MK minhashes
in all, where tables of their own would need 2K * M * M. Two documents of Jaccard similarity s meet in some table
with probability (1 - (1 - s^K)^M)^2: 0.917 at 0.6, 0.992 at 0.7 for K = 3, M = 13.

Half keys that no other text has are dropped before keys are formed, since no table of theirs can hold two texts.

Candidates are verified by the exact Jaccard similarity of their word shingles, and documents are grouped by the
connected components of the verified links. No bucket is compared pair by pair: each text is verified against its
bucket's least. The texts of buckets that then still hold several components, mostly those that share a passage but
little else, are joined among themselves by prefix filtering: of two texts of the threshold's similarity, each has
one of the shingles that they share among its rarest, a part of 1 - threshold of its shingles. That join is exact, so
no link between two texts of a bucket is lost, and a shared passage, whose shingles are not rare, gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.exact import _address, each_time, without
from mosaiq.session import written

WIDTH = 2  # words in a shingle
K, M = 3, 13
THRESHOLD = 0.6
_CHUNK = 1 << 20  # bytes of text that are hashed at once

_POWER = np.uint64(0x9E3779B97F4A7C15)  # odd: powers have inverses modulo 2^64
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets of the documents' shingles) for lower-case UTF-8 bytes of several documents.

    A word is a run of letters, digits and non-ASCII characters. A document of fewer than width words has its words
    as its one shingle; one without words has none. The hash is a polynomial one of the words, with one separator
    between them, taken from sums over all bytes.
    """
    n = len(offsets) - 1
    none = np.empty(0, np.uint64), np.zeros(n + 1, dtype=np.int64)
    if not len(data):
        return none
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    edges = offsets[1:-1]
    first[1:] &= ~inside[:-1]
    cut = edges[edges < len(data)]
    first[cut] = inside[cut]
    begins = np.flatnonzero(first)
    if not len(begins):
        return none
    # words become byte + 1 each after a 0, so a shingle is one stretch of the compact array
    keep = np.flatnonzero(inside)
    word = np.cumsum(first)[keep] - 1  # word of each byte kept
    place = np.arange(len(keep)) + word
    compact = np.zeros(len(keep) + len(begins), dtype=np.uint64)
    compact[place] = data[keep].astype(np.uint64) + np.uint64(1)
    start = place[np.flatnonzero(np.diff(word, prepend=-1))]
    total = len(compact)
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(compact * _powers(total, _POWER), out=sums[1:])
        words = np.searchsorted(begins, offsets)  # first word of each document
        per = np.diff(words)
        number = np.where(per >= width, per - width + 1, np.minimum(per, 1))
        out = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(number, out=out[1:])
        owner = np.repeat(np.arange(n), number)
        w = words[owner] + np.arange(out[-1]) - out[owner]
        last = np.minimum(w + width, words[owner + 1])
        ends = np.append(start[1:] - 1, total)
        a, b = start[w], ends[last - 1]
        back = _powers(total, _INVERSE)
        return _mix((sums[b] - sums[a]) * back[a]), out


_MUL = _mix(np.arange(1, 2 * K * M + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = _mix(np.arange(1001, 1001 + 2 * K * M, dtype=np.uint64))


def half_keys(hashes: np.ndarray, offsets: np.ndarray, k: int = K, m: int = M) -> np.ndarray:
    """int64[document, 2m]: the half keys of both collections. Documents without shingles have zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * m), dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for h in range(2 * m):
                key = np.zeros(len(full), dtype=np.uint64)
                for i in range(k):
                    f = h * k + i
                    values = hashes * _MUL[f] + _ADD[f]
                    values ^= values >> np.uint64(29)
                    key = _mix(key + np.minimum.reduceat(values, at) + np.uint64(f))
                out[full, h] = key
    return out.view(np.int64)


def _lower(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.lower().encode() for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def _texts(text_col: str) -> list[Column]:
    """A text's length and two hashes: texts that agree in all three are taken for the same."""
    return [*_address(text_col), F.xxhash64(F.lit(6), F.col(text_col)).alias("mq_more")]


_SAME = ["mq_len", "mq_hash", "mq_more"]


def _signed(docs: DataFrame, k: int, m: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(mq_id, mq_len, mq_hash, mq_more, mq_keys), one row for each of docs; mq_keys is null where there are no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.cumsum(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                upto = max(i + 1, int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + _CHUNK, side="right")))
                part = batch.slice(i, upto - i)
                hashes, offsets = shingles(*_lower(part.column(4).fill_null("").to_pylist()), width)
                keys = half_keys(hashes, offsets, k, m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * m, dtype=np.int32)), pa.array(keys.ravel()), mask=pa.array(np.diff(offsets) == 0))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], ["mq_id", *_SAME, "mq_keys"])
                i = upto

    rows = docs.select(F.col(id_col).alias("mq_id"), *_texts(text_col), F.col(text_col).alias("mq_text"))
    return rows.mapInArrow(sign, f"mq_id {kind}, mq_len bigint, mq_hash bigint, mq_more bigint, mq_keys array<bigint>")


def _classes(signed: DataFrame) -> DataFrame:
    """(node, mq_id, mq_len, mq_hash, mq_more, mq_keys): each distinct text, with its least id. Nodes are numbered in
    the order of (id, hashes), so which of two is the lesser doesn't depend on the run."""
    same = signed.where("mq_keys is not null").groupBy(*_SAME, "mq_keys").agg(F.min("mq_id").alias("mq_id"))
    order = [F.col("mq_id").asc_nulls_last(), *map(F.col, _SAME)]
    placed = same.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.select(F.monotonically_increasing_id().alias("node"), "mq_id", *_SAME, "mq_keys"))


def _buckets(classes: DataFrame, m: int) -> DataFrame:
    """(key, node, low): the tables' buckets of two texts and more, low the least node of each."""
    half = classes.select("node", F.posexplode("mq_keys").alias("i", "h"))
    several = half.groupBy("i", "h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("i", "h")
    # at most 2 * m half keys to a node
    held = written(half.join(several, ["i", "h"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("i", "h")).alias("of")))
    first, second = F.filter("of", lambda x: x["i"] < m), F.filter("of", lambda x: x["i"] >= m)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["i"], y["i"], x["h"], y["h"]))))
    rows = held.select(F.explode(tables).alias("key"), "node")
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    return written(rows.join(shared, "key"))


def _jaccard(pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose similarity is threshold or more, as (a, b, jaccard)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] | None = None
        for batch in batches:
            got = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta, tb = ta.as_py(), tb.as_py()
                if held is None or held[0] != ta:
                    held = ta, np.unique(shingles(*_lower([ta]), width)[0])
                b = np.unique(shingles(*_lower([tb]), width)[0])
                both = len(np.intersect1d(held[1], b, assume_unique=True))
                got.append(both / max(1, len(held[1]) + len(b) - both))
            got_ = np.array(got, dtype=float)
            near = pa.array(got_ >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got_)], ["a", "b", "jaccard"]).filter(near)

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(verify, f"a {kind}, b {kind}, jaccard double")


def _verified(edges: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs of nodes (a, b) whose texts, of the table (node, mq_text), are near."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    # the other document's text joins first; the bucket's least, which many pairs share, last
    pairs = edges.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return _jaccard(pairs, threshold, width)


def _close_pairs(mixed: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b, ra, rb): pairs of nodes of different roots that can be near, by prefix filtering over mixed (node, root).

    Texts of sizes n and n' share at least t = threshold / (1 + threshold) * (n + n') shingles if they are near, so in
    any order of shingles they meet within the first n - threshold * n + 1 of each. The order is by rarity. Where the
    shared shingle stands in the two bounds what they can share before and after it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                own = [np.unique(shingles(*_lower([t.as_py()]), width)[0]).view(np.int64) for t in part.column(2)]
                offsets = np.zeros(len(own) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in own], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))], ["node", "root", "of"])

    rows = mixed.join(texts, "node").select("node", "root", "mq_text").mapInArrow(sets, "node bigint, root bigint, of array<bigint>")
    rows = written(rows).select("node", "root", F.size("of").alias("n"), F.explode("of").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), (F.min("root") < F.max("root")).alias("mq_apart"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    ranked = rows.join(often, "s").withColumn("at", place)
    front = written(ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1) & F.col("mq_apart")).select("s", "node", "root", "n", "at"))
    x, y = front.toDF("s", "a", "ra", "na", "pa"), front.toDF("s", "b", "rb", "nb", "pb")
    can = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = (F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9
    return x.join(y, "s").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (can >= need)).select("a", "b", "ra", "rb").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, for all nodes of edges (a, b).

    Alternates large stars and small stars (links to the least neighbour) until nothing changes; each round is
    written, and the number of rounds is logarithmic in the longest path.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = written(links)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = written(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id, group_size, is_duplicate), one row for each row of docs.

    group_id is the least id of the document's group of near duplicates (connected components of the pairs of
    similarity threshold or more that share a key), group_size the number of rows in the group; is_duplicate: another
    row stays in place of it. Of each group just one row stays: that of the least id, null counting as larger than
    all others. Rows with the same text are in one group, whatever their ids; rows of one id with different texts are
    documents of their own. Texts that are null or have no words are in no group: they have their id as group_id,
    size 1. Other columns are not read. An empty table gives an empty result.
    """
    placed, alone = _grouped(docs, threshold, width, k, m, id_col, text_col)
    each = each_time(placed, "mq_rows", "mq_first")
    out = each.select(F.col("mq_id").alias(id_col), "group_id", "group_size", (~(F.col("mq_stays") & F.col("mq_first"))).alias("is_duplicate"))
    return out.unionByName(alone.select(F.col("mq_id").alias(id_col), F.col("mq_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(False).alias("is_duplicate")))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups calls duplicates; all columns stay as they are. Of rows repeated (same id
    and text) that stay, one stays, whatever their other columns. Null texts, texts without words and empty tables
    are as in near_groups."""
    placed, _ = _grouped(docs, threshold, width, k, m, id_col, text_col)
    marks = written(placed.where(~F.col("mq_stays") | (F.col("mq_rows") > 1)).select("mq_id", "mq_len", "mq_hash", F.col("mq_stays").alias("mq_again")))
    return without(docs, marks, id_col, text_col)


def _grouped(docs: DataFrame, threshold: float, width: int, k: int, m: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((mq_id, mq_len, mq_hash, mq_rows, group_id, group_size, mq_stays) of the rows that have words, those that agree
    in id and text as one; the other rows)."""
    signed = written(_signed(docs, k, m, width, id_col, text_col))
    classes = _classes(signed)
    roots = _roots(docs, classes, threshold, width, m, id_col, text_col)
    rows = signed.where("mq_keys is not null").groupBy("mq_id", *_SAME).agg(F.count(F.lit(1)).alias("mq_rows"))
    rows = rows.join(classes.select("node", *_SAME), _SAME).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows.select("mq_id", *_SAME, "mq_rows", "root"))
    order = F.struct(F.col("mq_id").isNull(), "mq_id", "mq_hash", "mq_more")
    groups = rows.groupBy("root").agg(F.min(order).alias("mq_least"), F.sum("mq_rows").alias("group_size"))
    placed = rows.join(groups, "root").select("mq_id", "mq_len", "mq_hash", "mq_rows", F.col("mq_least")["mq_id"].alias("group_id"), "group_size", (order == F.col("mq_least")).alias("mq_stays"))
    return placed, signed.where("mq_keys is null").select("mq_id")


def _roots(docs: DataFrame, classes: DataFrame, threshold: float, width: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of the texts that are in groups of several."""
    shared = _buckets(classes, m)
    stars = written(shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "mq_id", *_SAME)
    rows = docs.select(F.col(id_col).alias("mq_i"), *[c.alias(f"mq_d{i}") for i, c in enumerate(_texts(text_col))], F.col(text_col).alias("mq_text"))
    same = rows["mq_i"].eqNullSafe(wanted["mq_id"])
    for i, c in enumerate(_SAME):
        same &= rows[f"mq_d{i}"] == wanted[c]
    # rows repeated are one text
    texts = written(rows.join(wanted.hint("merge"), same).groupBy("node").agg(F.any_value("mq_text").alias("mq_text")))
    near = written(_verified(stars, texts, threshold, width).select("a", "b"))
    roots = written(components(near))
    placed = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = written(placed)
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    mixed = written(placed.join(apart, "key", "left_semi").select("node", "root").distinct())
    if mixed.isEmpty():
        return roots
    pairs = written(_close_pairs(mixed, texts, threshold, width))
    more = written(_verified(pairs.select("a", "b"), texts, threshold, width).select("a", "b").join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if more.isEmpty():
        return roots
    merged = written(components(more).select(F.col("node").alias("root"), F.col("root").alias("mq_to")))
    old = roots.join(merged, "root", "left").select("node", F.coalesce("mq_to", "root").alias("root"))
    return written(old.unionByName(merged.select(F.col("root").alias("node"), F.col("mq_to").alias("root"))).distinct())
