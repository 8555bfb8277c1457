"""Language-model scoring by online logistic context mixing, in bits per byte.

A byte is a path of binary decisions in a code tree (Huffman, by the stream's bytes). For each decision several
predictors, counts in tables addressed by a hash of their context (the bytes before, the word so far) and the tree
node, give log odds; a match predictor finds where the last MATCH bytes stand elsewhere in the stream and expects the
byte that follows there. A logistic mixer weighs them with weights that the node and the match's length select, and a
last table refines its answer by what happened before at that node and confidence. All parts learn online from the
text they have just predicted.

Each distinct text is scored once, with the number of its copies. Distinct texts are split by hash into streams of a
set size; one task learns from a stream while it scores it, so the number of models follows the corpus and all of its
text is learnt from. Inside a stream numpy works on blocks of bytes: a block is predicted with what was learnt before
it, then learnt.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.exact import _address

STREAM = 16 << 20  # bytes of text that one model learns from, on average
BLOCK = 8192  # bytes predicted before they are learnt
TABLE_BITS = 20  # slots of a predictor's table, as a power of two
WARM = 1 << 18  # bytes at a stream's start that are scored again, by a model that has learnt as many that follow them
ORDERS = (2, 4)  # bytes of context; one predictor more takes the word so far
MATCH = 12  # bytes that must be the same for a match to begin
_SAMPLED = 3  # bits of a place's hash that must be 0 for matches to begin there: content picks one place in eight
_GATES = 4  # sets of weights: no match, and matches of under 16, under 32 and more bytes
_LENGTHS = 8  # steps of a match's length in the match predictor
_CONTEXTS = len(ORDERS) + 1
_BUCKETS = 24  # steps of confidence in the refining table
_RATE = 0.3
_STRETCH = 1 << 20  # bytes of whole documents for which contexts are made at once


def _tree(frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, node[byte, step], bit[byte, step]) of a Huffman code over all 256 bytes."""
    heap: list = [(int(w) * 256 + 1, b, b) for b, w in enumerate(frequency)]
    heapq.heapify(heap)
    n = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a[2], b[2])))
        n += 1
    length = np.zeros(256, dtype=np.int64)
    paths: dict[int, list[tuple[int, int]]] = {}
    nodes = 0
    todo: list = [(heap[0][2], [])]
    while todo:
        tree, path = todo.pop()
        if isinstance(tree, tuple):
            me, nodes = nodes, nodes + 1
            todo += [(tree[1], [*path, (me, 1)]), (tree[0], [*path, (me, 0)])]
        else:
            paths[tree], length[tree] = path, len(path)
    node = np.zeros((256, int(length.max())), dtype=np.int64)
    bit = np.zeros_like(node)
    for b, path in paths.items():
        for j, (x, y) in enumerate(path):
            node[b, j], bit[b, j] = x, y
    return length, node, bit


_POWER = np.uint32(0x9E3779B1)
_INVERSE = np.uint32(pow(int(_POWER), -1, 1 << 32))


def _mix32(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint32(16))) * np.uint32(0x7FEB352D)
    z = (z ^ (z >> np.uint32(15))) * np.uint32(0x846CA68B)
    return z ^ (z >> np.uint32(16))


def _powers(base: np.uint32, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2^32."""
    out, k = np.ones(n, dtype=np.uint32), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint32(pow(int(base), k, 1 << 32))
        k *= 2
    return out


def contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each predictor the hash (uint32) of its context at each byte; contexts don't reach into another document."""
    n = len(data)
    wide = data.astype(np.uint32)
    wide += np.uint32(1)
    start, sizes = offsets[:-1], np.diff(offsets)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint32)
        for k in range(1, max(ORDERS) + 1):
            h *= _POWER
            if n > k:
                h[k:] += wide[:-k]
                for j in range(k):  # the first k bytes of a document took one of a document before
                    at = start[sizes > j] + j
                    at = at[at >= k]
                    h[at] -= wide[at - k]
            if k in ORDERS:
                out.append(_mix32(h + np.uint32(k * 0x10000000)))
        letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
        begins = np.ones(n, dtype=bool)  # documents, and what follows a byte that is no letter
        begins[1:] = ~letter[:-1]
        begins[start[sizes > 0]] = True
        first = np.flatnonzero(begins)
        long = np.diff(first, append=n)
        sums = np.zeros(n + 1, dtype=np.uint32)
        np.cumsum(wide * _powers(_POWER, n), dtype=np.uint32, out=sums[1:])
        word = sums[:-1] - np.repeat(sums[first], long)
        word *= np.repeat(_powers(_INVERSE, n)[first], long)
        out.append(_mix32(word * np.uint32(0x2C1B3C6D) + np.uint32(0x9E3779B9)))
    return out


def _stretches(offsets: np.ndarray, i: int, upto: int):
    """(first, last) of whole documents, about _STRETCH bytes each."""
    while i < upto:
        j = min(upto, max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STRETCH, side="right")) - 1))
        yield i, j
        i = j


def _windows(these: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size bytes that follow each other: a polynomial, made of those of half the size."""
    if size == 1:
        return these.astype(np.uint64)
    half = size // 2
    h = _windows(these, half)
    h = h[:-half] * np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64)) + h[half:]
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + these[size - 1 :] if size % 2 else h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, source): places at which a match begins, and where in the stream the same MATCH bytes end otherwise: the
    last time before, or, if there is none, the first time in a later document."""
    places, hashes = [], []
    for i, j in _stretches(offsets, 0, len(offsets) - 1):
        low, these = int(offsets[i]), data[offsets[i] : offsets[j]]
        if len(these) <= MATCH:
            continue
        with np.errstate(over="ignore"):
            h = _windows(these[:-1], MATCH)  # of the MATCH bytes before each place
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        picked = np.flatnonzero((h >> np.uint64(64 - _SAMPLED)) == 0)
        place = picked + low + MATCH
        inside = place - np.repeat(offsets[i:j], np.diff(np.searchsorted(place, offsets[i : j + 1]))) >= MATCH
        places.append(place[inside])
        hashes.append(h[picked[inside]])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, h = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, at = h[order], place[order]
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(place, offsets)))[order]
    same = h[1:] == h[:-1]
    source = np.full(len(at), -1, dtype=np.int64)
    source[1:][same] = at[:-1][same]
    # of places with no earlier one, the next ones of the same document are passed over
    first, changes = np.flatnonzero(source < 0), np.append(np.flatnonzero((document[1:] != document[:-1]) | ~same) + 1, len(at))
    after = changes[np.searchsorted(changes, first, side="right")] if len(first) else first
    there = np.minimum(after, len(at) - 1)
    found = (after < len(at)) & (h[there] == h[first])
    source[first[found]] = at[there[found]]
    back = np.empty_like(source)
    back[order] = source
    some = back >= 0
    return place[some], back[some]


def _line(size: int) -> np.ndarray:
    """Zeros (float32) that begin where a cache line does."""
    room = np.zeros(size + 16, dtype=np.float32)
    skip = -room.ctypes.data % 64 // 4
    return room[skip : skip + size]


class Mixer:
    def __init__(self, frequency: np.ndarray, bits: int = TABLE_BITS):
        self.length, node, bit = _tree(frequency)
        self.steps = node.shape[1]
        self.node, self.bit = node.ravel(), bit.ravel()
        self.mask = np.uint32((1 << bits) - 1)
        nodes = self.nodes = int(node.max()) + 1
        self.counts = [_line(2 << bits) for _ in range(_CONTEXTS)]
        self.both = [c.view(np.complex64) for c in self.counts]  # a slot's two counts as one number
        self.matched = np.tile(np.array([1.0, 3.0]), (_LENGTHS, 1))  # misses and hits by the match's length
        self.weights = [np.full(nodes * _GATES, 0.4 if c < _CONTEXTS else 0.8, dtype=np.float32) for c in range(_CONTEXTS + 1)]
        self.squares = [np.full(nodes * _GATES, 1e-3) for _ in range(_CONTEXTS + 1)]
        centre = 1 / (1 + np.exp(-(np.arange(_BUCKETS) - _BUCKETS / 2 + 0.5) / 2))
        self.refine = np.stack([np.tile(4 * (1 - centre), nodes), np.tile(4 * centre, nodes)])
        self.refined = (self.refine[1] / self.refine.sum(axis=0)).astype(np.float32)
        self.spread = _mix32(np.arange(1, nodes + 1, dtype=np.uint32))
        # what the hash's slot is changed by at each step of each byte, for the count of its bit
        self.code = (self.spread & self.mask).astype(np.int64)[self.node] << 1 | self.bit
        self.order = np.arange(1 << 16)

    def block(self, data: np.ndarray, hashes: list[np.ndarray], guess: np.ndarray | None = None, size: np.ndarray | None = None, learn: bool = True) -> np.ndarray:
        """Bits that each byte of the block costs; then the block is learnt. guess: the byte that a match expects, -1
        for none; size: the match's length."""
        length = self.length.take(data)
        ends = np.cumsum(length)
        n = int(ends[-1])
        if n > len(self.order):
            self.order = np.arange(2 * n)
        owner = np.repeat(self.order[: len(data)], length)  # the byte of each decision
        path = (data * np.int64(self.steps) - (ends - length)).take(owner, mode="clip")
        path += self.order[:n]
        node = self.node.take(path, mode="clip")
        code = self.code.take(path, mode="clip")
        bit = code & 1
        target = bit.astype(np.float32)
        gated = node
        says = None
        if guess is not None and (have := np.flatnonzero(guess >= 0)).size:
            step = np.minimum(size[have].astype(np.int64) // 8, _LENGTHS - 1)
            gate = np.zeros(len(data), dtype=np.int64)
            gate[have] = np.minimum(step // 2 + 1, _GATES - 1) * self.nodes
            gated = gate.take(owner, mode="clip")
            gated += node
            # the guess speaks at the nodes that its own path has as well
            long = length[have]
            upto = np.cumsum(long)
            there = np.repeat(ends[have] - upto, long) + self.order[: upto[-1]]
            own = path.take(there) + np.repeat((guess[have].astype(np.int64) - data[have]) * self.steps, long)
            on = self.node.take(own, mode="clip") == node.take(there)
            says, expected, kind = there[on], self.bit.take(own[on], mode="clip"), np.repeat(step, long)[on]
            strength = np.log((self.matched[:, 1] + 0.3) / (self.matched[:, 0] + 0.3)).astype(np.float32)
            voice = strength.take(kind) * (2 * expected - 1).astype(np.float32)
        total = np.zeros(n, dtype=np.float32)
        odds = []
        for c in range(_CONTEXTS):
            slot = ((hashes[c] & self.mask).astype(np.int64) << 1).take(owner, mode="clip")
            slot ^= code
            pair = self.both[c].take(slot >> 1, mode="clip")
            if learn:  # the counts are copied, so that their places can be used while they are at hand
                np.add.at(self.counts[c], slot, np.float32(1))
            pair = pair.view(np.float32)
            pair += np.float32(0.15)
            s = pair[1::2] / pair[::2]
            np.log(s, out=s)
            weighed = self.weights[c].take(gated, mode="clip")
            weighed *= s
            total += weighed
            odds.append(s)
        if says is not None:
            total[says] += self.weights[_CONTEXTS].take(gated[says]) * voice
        np.clip(total, -15, 15, out=total)
        p = np.exp(-total)
        p += 1
        np.reciprocal(p, out=p)
        total *= np.float32(2)
        total += np.float32(_BUCKETS / 2)
        np.clip(total, 0, _BUCKETS - 1, out=total)
        cell = total.astype(np.int64)
        cell += node * _BUCKETS
        chance = self.refined.take(cell, mode="clip")
        chance += p
        chance *= np.float32(0.5)
        error = target - p
        chance -= 1 - target
        np.abs(chance, out=chance)  # what the decision that came was given
        np.log(chance, out=chance)
        cost = np.bincount(owner, weights=chance, minlength=len(data))
        if learn:
            for c in range(_CONTEXTS):
                self._weigh(c, gated, error * odds[c])
            if says is not None:
                self._weigh(_CONTEXTS, gated[says], error[says] * voice)
                hit = (expected == bit[says]).astype(np.int64)
                self.matched += np.bincount(2 * kind + hit, minlength=2 * _LENGTHS).reshape(-1, 2)
            cell += bit * (self.nodes * _BUCKETS)
            self.refine += np.bincount(cell, minlength=2 * self.nodes * _BUCKETS).reshape(2, -1)
            self.refined = (self.refine[1] / self.refine.sum(axis=0)).astype(np.float32)
        return cost * (-1 / np.log(2))

    def _weigh(self, c: int, gated: np.ndarray, slope: np.ndarray) -> None:
        gradient = np.bincount(gated, weights=slope, minlength=self.nodes * _GATES)
        self.squares[c] += gradient * gradient
        self.weights[c] += (_RATE * gradient / np.sqrt(self.squares[c])).astype(np.float32)


def _runs(begin: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin + 0, 1, .. below long; 0, 1, .. below long) of all runs, one after the other."""
    since = np.arange(int(long.sum()))
    since -= np.repeat(np.cumsum(long) - long, long)
    return np.repeat(begin, long) + since, since


def guesses(data: np.ndarray, offsets: np.ndarray, low: int, high: int, place: np.ndarray, source: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(guess, size) for data[low:high], whole documents. A match goes on until it is wrong for once, or the document
    ends. In the documents of own, which have copies, the copy is the match, from the byte after the first MATCH on."""
    guess = np.full(high - low, -1, dtype=np.int16)
    size = np.zeros(high - low, dtype=np.int32)
    i, j = np.searchsorted(place, [low, high])
    begin, there = place[i:j], source[i:j]
    # up to the next match, the end of the document or that of the stream
    upto = np.minimum(np.append(begin[1:], high), offsets[np.searchsorted(offsets, begin, side="right")])
    long = np.minimum(upto - begin, len(data) - there)
    where, since = _runs(there, long)
    at = where + np.repeat(begin - there, long)
    expected = data.take(where, mode="clip")
    wrong = np.append(np.flatnonzero(expected != data.take(at, mode="clip")), len(at))
    first = np.cumsum(long) - long
    sound = np.flatnonzero(since <= np.repeat(wrong[np.searchsorted(wrong, first)] - first, long))
    at = at[sound] - low
    guess[at], size[at] = expected[sound], MATCH + since[sound]
    d, e = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high, side="left")
    copied = np.flatnonzero(own[d:e] & (np.diff(offsets[d : e + 1]) > MATCH)) + d
    if len(copied):
        at, since = _runs(offsets[copied] + MATCH, offsets[copied + 1] - offsets[copied] - MATCH)
        guess[at - low], size[at - low] = data[at], MATCH + since
    return guess, size


def _learn(mixer: Mixer, data: np.ndarray, offsets: np.ndarray, i: int, upto: int, block: int, match: tuple) -> np.ndarray:
    """Documents i to upto go through the mixer: the bits that each costs."""
    bits, first = np.zeros(max(0, upto - i)), i
    # contexts and costs are made for stretches of whole documents, so that what is held stays small
    for i, j in _stretches(offsets, i, upto):
        low, high = int(offsets[i]), int(offsets[j])
        if high > low:
            these = data[low:high]
            hashes = contexts(these, offsets[i : j + 1] - low)
            guess, size = guesses(data, offsets, low, high, *match)
            cost = [mixer.block(these[a : a + block], [h[a : a + block] for h in hashes], guess[a : a + block], size[a : a + block]) for a in range(0, high - low, block)]
            bits[i - first : j - first] = np.add.reduceat(np.append(np.concatenate(cost), 0), offsets[i:j] - low)
    return bits * (np.diff(offsets[first : upto + 1]) > 0) if upto > first else bits


def score(texts: list[bytes], copied: np.ndarray | None = None, warm: int = WARM, block: int = BLOCK) -> np.ndarray:
    """Bits that each text costs, as one stream in the order given; the first warm bytes after those that follow them.
    copied: whether a text has copies beside it."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    own = np.zeros(len(texts), dtype=bool) if copied is None else copied
    match = (*anchors(data, offsets), own)
    frequency = np.bincount(data, minlength=256)
    bits = _learn(Mixer(frequency), data, offsets, 0, len(texts), block, match)
    head = int(np.searchsorted(offsets, min(warm, len(data) // 2), side="right")) - 1
    if head > 0:
        after = min(int(np.searchsorted(offsets, offsets[head] + warm)), len(texts))
        mixer = Mixer(frequency)
        _learn(mixer, data, offsets, head, after, block, match)
        bits[:head] = _learn(mixer, data, offsets, 0, head, block, match)
    return bits


def lm_scores(docs: DataFrame, stream_bytes: int = STREAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, total_bits, bits_per_byte), one row for each row of docs.

    A text's bits are those of a model of its stream without the text itself: counts and weights have learnt the texts
    before it (order: a hash of the text; the first WARM bytes, which have no such past, come after as many that follow
    them), and matches are looked for in the whole stream, in what precedes and in later texts. A text that occurs
    several times is scored once, as a text whose copy is in the corpus, and all its rows get that score; so rows
    repeated don't make a stream longer. A null text has nulls; the empty text has 0 bits and a null rate. Texts of any
    length are scored whole. A null id is carried; other columns are not read. An empty table gives an empty result.
    """
    same = ["mq_len", "mq_hash", "mq_more"]
    keys = [*_address(text_col), F.xxhash64(F.lit(6), F.col(text_col)).alias("mq_more")]
    rows = docs.where(F.col(text_col).isNotNull())
    total = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    streams = max(1, -(-total // stream_bytes))
    distinct = rows.groupBy(F.col(text_col).alias("mq_text")).agg(F.count(F.lit(1)).alias("mq_n"))
    distinct = distinct.select(*[c.alias(n) for c, n in zip([F.octet_length("mq_text").cast("bigint"), F.xxhash64("mq_text"), F.xxhash64(F.lit(6), F.col("mq_text"))], same)], (F.col("mq_n") > 1).alias("mq_copied"), F.col("mq_text").cast("binary").alias("mq_text"))
    distinct = distinct.withColumn("mq_stream", F.pmod(F.xxhash64(F.lit(13), "mq_hash"), F.lit(streams)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("mq_hash", "mq_more", "mq_len")]).combine_chunks() if table.num_rows else table
        texts = [x.as_buffer().to_pybytes() for x in table.column("mq_text")]
        bits = score(texts, np.array(table.column("mq_copied").to_pylist(), dtype=bool))
        return pa.table({**{c: table.column(c) for c in same}, "mq_bits": pa.array(bits)})

    found = distinct.groupBy("mq_stream").applyInArrow(run, "mq_len bigint, mq_hash bigint, mq_more bigint, mq_bits double")
    scored = rows.select(F.col(id_col).alias("mq_id"), *keys).join(found, same)
    rate = F.when(F.col("mq_len") > 0, F.col("mq_bits") / F.col("mq_len"))
    out = scored.select(F.col("mq_id").alias(id_col), F.col("mq_len").alias("n_bytes"), F.col("mq_bits").alias("total_bits"), rate.alias("bits_per_byte"))
    none = docs.where(F.col(text_col).isNull()).select(F.col(id_col), F.lit(None).cast("bigint").alias("n_bytes"), F.lit(None).cast("double").alias("total_bits"), F.lit(None).cast("double").alias("bits_per_byte"))
    return out.unionByName(none)
