"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton over byte classes. A document is parsed greedily into the
longest phrases that occur in that text, from its beginning to its end; the fewer phrases, the closer the language. Phrases are normalised by what
a text over the same alphabet costs: c * log2(n) / n bits a byte, n the length in symbols. The language with the
least wins. All automata are transition tables, and many documents are walked in lockstep by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample that the classifier is fitted on: documents and bytes for each language.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 24_000
#: A document is walked in segments of this many bytes, all at once. Phrases go on from one to the next.
SEGMENT = 2048
#: Bytes before a segment at which its walk begins, to come into step with the segment before it.
LEAD = 96
#: Bytes of whole documents that are walked at a time.
PART = 4 << 20
#: Segments that are walked at a time: what a task holds doesn't grow with the batch.
LOCKSTEP = 1024
#: A document is rejected if its letters are fewer than this, or its phrases more than the limit.
MIN_LETTERS = 1
#: Limit of the phrases, as a multiple of the mean of uniformly random letters of the same length under the same automata.
REJECT = 0.9
#: Phrases that are allowed besides: the end of a text cuts its last phrase short.
CUT = 1
#: Lengths at which random letters are parsed. Between them phrases are interpolated; beyond, they grow with the length.
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, SEGMENT])

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def _folded() -> np.ndarray:
    """Byte to symbol: ASCII letters without case, other ASCII as one separator, bytes of UTF-8 sequences themselves.

    The second byte of capital letters of Latin-1 (C3 80 to C3 9E) is folded to that of the small ones by fold().
    """
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    for c in range(97, 123):
        out[c] = out[c - 32] = c
    return out


_FOLD = _folded()


def fold(data: np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes (uint8 array), one for each byte."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


class SuffixAutomaton:
    def __init__(self, symbols: bytes):
        link, length, nexts = [-1], [0], [{}]
        last = 0
        for c in symbols:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    nexts.append(dict(nexts[q]))
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.nexts = nexts


class CrossParser:
    """Automata of all languages in one table: step[state + class], 0 where there is no way on."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        folded = {k: fold(np.frombuffer(texts[k], np.uint8)).tobytes() for k in self.languages}
        used = sorted({b for t in folded.values() for b in t})
        self.kind = np.zeros(256, dtype=np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)  # class 0: in no language's text
        width = self.width = len(used) + 1
        tables, self.roots, base = [np.zeros(width, dtype=np.int32)], [], 1
        for k in self.languages:
            nexts = SuffixAutomaton(folded[k]).nexts
            table = np.zeros((len(nexts), width), dtype=np.int32)
            for s, arcs in enumerate(nexts):
                for c, to in arcs.items():
                    table[s, self.kind[c]] = (base + to) * width
            tables.append(table.ravel())
            self.roots.append(base * width)
            base += len(nexts)
        self.step = np.concatenate(tables)
        self.random = self._random_phrases()

    def _random_phrases(self) -> np.ndarray:
        """Fewest phrases, on average, of texts of letters drawn uniformly, words of five: what no language looks like. One figure for each of LENGTHS."""
        rng = np.random.default_rng(5)
        offsets = np.concatenate([[0], np.cumsum(np.repeat(LENGTHS, 100))])
        data = rng.integers(97, 123, offsets[-1]).astype(np.uint8)
        data[::6] = 32
        counts, _ = self.phrases(data, offsets)
        return counts.min(axis=1).reshape(len(LENGTHS), 100).mean(axis=1)

    def limits(self, sizes: np.ndarray) -> np.ndarray:
        """Most phrases that documents of these sizes may have."""
        expected = np.interp(sizes, LENGTHS, self.random) * np.maximum(1, sizes / SEGMENT)
        return REJECT * expected + CUT

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases[document, language], letters[document]) of the documents data[offsets[i]:offsets[i + 1]]."""
        n = len(offsets) - 1
        counts = np.zeros((n, len(self.roots)), dtype=np.int64)
        sizes = np.diff(offsets)
        if not len(data):
            return counts, np.zeros(n, dtype=np.int64)
        letters = np.add.reduceat(np.append(_LETTER[data], False), offsets[:-1], dtype=np.int64) * (sizes > 0)
        folded = fold(data)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(n), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, offsets[owner + 1] - start)
        begun = np.zeros((len(self.roots), len(owner)), dtype=np.int64)
        before, after = (np.zeros((len(self.roots), len(owner)), dtype=np.int32) for _ in range(2))
        # no way leads on from state 0: a document's first byte begins a phrase
        self._walk(folded, start, size, np.flatnonzero(nth == 0), 0, begun, before, after)
        self._walk(folded, start, size, np.flatnonzero(nth > 0), LEAD, begun, before, after)
        # a walk that came to its segment in another state than the segment before has left is done again from that state
        while True:
            astray = np.zeros(len(owner) + 1, dtype=bool)
            astray[1:-1] = (nth[1:] > 0) & (before[:, 1:] != after[:, :-1]).any(axis=0)
            again = np.flatnonzero(astray[:-1] & ~np.append(False, astray[:-2]))
            if not len(again):
                break
            before[:, again] = after[:, again - 1]
            self._walk(folded, start, size, again, 0, begun, before, after)
        for j in range(len(self.roots)):
            counts[:, j] = np.bincount(owner, weights=begun[j], minlength=n).astype(np.int64)
        return counts, letters

    def _walk(self, folded: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray, lead: int, begun: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Walk segments in lockstep from state before, or, with lead, from the start state lead bytes earlier; begun gets
        the phrases that begin in each, before and after the states at its ends."""
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        step = self.step
        which = which[np.argsort(-size[which], kind="stable")]
        for low in range(0, len(which), LOCKSTEP):
            group = which[low : low + LOCKSTEP]
            begin, long = start[group] - lead, size[group] + lead
            # symbols of the group's segments, one row for each place, so that a step reads one stretch of memory
            at = begin[None, :] + np.arange(long[0])[:, None]
            kinds = self.kind.take(folded.take(at, mode="clip"))
            live = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")  # segments longer than t
            state = np.zeros((len(roots), len(group)), dtype=np.int32) if lead else before[:, group]
            found = np.zeros((len(roots), len(group)), dtype=np.int32)
            for t in range(int(long[0])):
                if t == lead:
                    before[:, group] = state
                    found[:] = 0
                m = live[t]
                c = kinds[t, :m]
                to = step.take(state[:, :m] + c)
                fail = to == 0
                # a phrase begins with this byte; if the text doesn't have it, it is a phrase itself
                found[:, :m] += fail
                state[:, :m] = np.where(fail, step.take(roots + c), to)
            after[:, group], begun[:, group] = state, found

    @staticmethod
    def rates(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = np.maximum(sizes, 1)[:, None]
        return counts * np.log2(n + 1) / n

    def identify(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(language or None, best rate, runner-up's rate less the best) for each document."""
        counts, letters = self.phrases(data, offsets)
        sizes = np.diff(offsets)
        rate = self.rates(counts, sizes)
        best = rate.argmin(axis=1)  # of equals the first by name
        least = rate[np.arange(len(best)), best]
        second = np.partition(rate, 1, axis=1)[:, 1] if rate.shape[1] > 1 else least
        # phrases a byte don't fall with the length, so they are held to random letters of the same length, not to the rate
        known = (letters >= MIN_LETTERS) & (counts.min(axis=1) <= self.limits(sizes))
        return [self.languages[b] if ok else None for b, ok in zip(best, known)], least, second - least


def labelled_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Text of each language: sample_docs different labelled documents, least hash of id and text first, an even share of
    sample_bytes from each. What is collected is bounded by these two for each language, whatever ids are null or repeated."""
    usable = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    order = F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.col(text_col))
    ranked = usable.select(F.col(lang_col).cast("string").alias("mq_lang"), order.alias("mq_h"))
    ranked = ranked.withColumn("mq_rank", F.dense_rank().over(Window.partitionBy("mq_lang").orderBy("mq_h"))).where(F.col("mq_rank") <= sample_docs)
    chosen = ranked.select("mq_h").distinct()  # ranked without the texts, which are then read for the chosen few
    texts_of = usable.select(F.col(lang_col).cast("string").alias("mq_lang"), order.alias("mq_h"), F.substring(F.col(text_col).cast("binary"), 1, sample_bytes).alias("mq_text"))
    ranked = texts_of.where(F.col("mq_h").isin([r[0] for r in chosen.collect()])).groupBy("mq_lang", "mq_h").agg(F.any_value("mq_text").alias("mq_text"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["mq_lang"], r["mq_h"], bytes(r["mq_text"]))):
        if len(out.setdefault(r["mq_lang"], [])) < sample_docs:
            out[r["mq_lang"]].append(bytes(r["mq_text"]))
    texts = {}
    for lang, parts in out.items():
        left, chosen = sample_bytes, []
        for i, part in enumerate(parts):
            share = -(-left // (len(parts) - i))
            chosen.append(part[:share])
            left -= len(chosen[-1])
        texts[lang] = b"\n".join(chosen)
    return texts


def fit(docs: DataFrame, **options) -> CrossParser | None:
    """A parser for the languages labelled in docs; None if no row is usable."""
    texts = labelled_sample(docs, **options)
    return CrossParser(texts) if texts else None


def _identified(docs: DataFrame, parser: CrossParser | None, text_col: str, keep: list, out: str, at: int | None = None) -> DataFrame:
    """keep with identified, bits and margin. at: which of keep is the text; None: none of them."""
    kept = len(keep)
    at = kept if at is None else at
    if parser is None:
        return docs.select(*keep, F.lit(None).cast("string").alias("identified"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            texts = whole.column(at)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
            i = 0
            while i < whole.num_rows:
                upto = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART, side="right")))
                batch, part = whole.slice(i, upto - i), texts.slice(i, upto - i).cast(pa.large_string()).cast(pa.large_binary())
                valid = np.asarray(part.is_valid())
                filled = part.fill_null(b"")
                offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
                data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                language, least, margin = p.identify(data, offsets - offsets[0])
                none = np.array([x is None for x in language], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:kept], pa.array(language, pa.string()), pa.array(least.astype(float), mask=none | ~valid), pa.array(margin.astype(float), mask=none | ~valid)],
                    [*batch.schema.names[:kept], "identified", "bits", "margin"],
                )
                i = upto

    return docs.select(*keep, *([F.col(text_col).alias("mq_text")] if at == kept else [])).mapInArrow(identify, out)


def identify_language(docs: DataFrame, parser: CrossParser | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, label, identified, bits, margin), one row for each row of docs.

    label is the row's own language column, identified the language found, bits its phrases normalised, margin by
    how much the runner-up is worse. identified, bits and margin are null where the document is rejected: null and
    empty texts, texts of under MIN_LETTERS letters, and texts that parse hardly better than random letters of the same length.
    Of languages that tie the first by name wins. A null label takes no part in fitting. Repeated rows get the same
    answer each. Without labelled rows all are rejected. An empty table gives an empty result.
    """
    parser = parser or fit(docs, lang_col=lang_col, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    keep = [F.col(id_col), F.col(lang_col).cast("string").alias("label")]
    return _identified(docs, parser, text_col, keep, f"`{id_col}` {kind}, label string, identified string, bits double, margin double")


def keep_identified(docs: DataFrame, parser: CrossParser | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the documents that identify_language rejects (null and empty texts among them); all columns stay as
    they are. Null ids and labels, repeated rows and empty tables are as there."""
    parser = parser or fit(docs, lang_col=lang_col, id_col=id_col, text_col=text_col)
    if parser is None:
        return docs.limit(0)
    names = [f"mq_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    text = names[docs.columns.index(text_col)]
    found = _identified(renamed, parser, text, [F.col(n) for n in names], f"{schema}, identified string, bits double, margin double", docs.columns.index(text_col))
    return found.where("identified is not null").select(*names).toDF(*docs.columns)
