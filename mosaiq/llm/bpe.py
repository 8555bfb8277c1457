"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

The vocabulary, with bytes mapped to Latin-1 characters, is a pyahocorasick trie. A piece of text is covered from
the left by the longest token; a token is kept if it is compatible with the one before, that is if merging would
give just this pair, and else gives way to the next shorter one, or takes its predecessor back with it. A bit for
each position bars it from being tried twice, so time is linear in the piece. The result is that of the merges.

Compatibility of two adjacent tokens is found by undoing merges in order of rank, and memoised.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 400_000  # pieces whose ids a worker remembers; others are computed anew
PAIRS = 4_000_000  # pairs of tokens whose compatibility it remembers, after which it begins anew
_SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(kind: str, top: int) -> str:
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def _pattern(top: int) -> re.Pattern:
    """The published pre-tokenisation pattern, its \\p{L}, \\p{N} and \\s spelled out up to the code point top."""
    letter, number = _ranges("L", top), _ranges("N", top)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def pieces(text: str) -> list[str]:
    astral = len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)
    return _pattern(sys.maxunicode if astral else 0xFFFF).findall(text)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Bpe(dict):
    """A dictionary from piece to the bytes of its ids (int32); missing pieces are encoded."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        super().__init__()
        self.ranks, self.memo = ranks, memo
        self.token = [b""] * (max(ranks.values()) + 1)
        self.trie = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.token[r] = t
            self.trie.add_word(t.decode("latin-1"), r)
        self.spelled = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.size = [len(t) for t in self.token]
        self.most = max(self.size)
        self.parts = [(r, r) for r in range(len(self.token))]
        self.pairs: dict[tuple[int, int], int] = {}
        for t, r in ranks.items():
            if len(t) > 1 and (halves := self._halves(t, r)):
                self.parts[r] = halves
                self.pairs[halves] = r
        self.shorter = [-1] * len(self.token)
        for t, r in self.spelled.items():
            self.shorter[r] = next((q for n in range(len(t) - 1, 0, -1) if (q := self.spelled.get(t[:n])) is not None), -1)
        self.fits: dict[int, dict[int, bool]] = defaultdict(dict)
        self.fitted = 0

    def _halves(self, t: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None if merges never make it."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            low, at = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if low >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends in just these two: undo merges, latest first, and look for a
        pair across the border that would have been merged before the one undone."""
        key, limit, parts, pairs = (a, b), 1 << 60, self.parts, self.pairs
        while True:
            if pairs.get((a, b), limit) < limit:
                fits = False
                break
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        fits = True
                        break
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        fits = True
                        break
        self.fitted += 1
        if self.fitted > PAIRS:
            self.fits.clear()
            self.fitted = 0
        self.fits[key[0]][key[1]] = fits
        return fits

    def ids(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        text, n, most = data.decode("latin-1"), len(data), self.most
        spelled, size, fits, shorter, deepest = self.spelled, self.size, self.fits, self.shorter, self.trie.longest_prefix
        barred = bytearray(n + 1)
        out: list[int] = []
        at, row = 0, None
        while at < n:
            k = deepest(text[at : at + most])
            while (take := spelled.get(text[at : at + k])) is None:
                k -= 1
            while True:
                end = at + size[take]
                if not barred[end]:
                    if row is None:
                        break
                    if (ok := row.get(take)) is None:
                        ok = self._compatible(out[-1], take)
                    if ok:
                        break
                take = shorter[take]
                while take < 0:  # no token fits here: the one before gives way to the next shorter
                    barred[at] = 1
                    take = out.pop()
                    at -= size[take]
                    row = fits[out[-1]] if out else None
                    take = shorter[take]
            out.append(take)
            row = fits[take]
            at = end
        return out

    def __missing__(self, piece: str) -> bytes:
        out = array("i", self.ids(piece.encode("utf-8"))).tobytes()
        if len(self) < self.memo and len(piece) < 64:
            self[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces(text))), dtype="<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_built: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One encoder for each Python worker and vocabulary."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Bpe(shared.ranks)
    return _built[shared.id]


class _Shared:
    def __init__(self, broadcast, number: int):
        self._broadcast, self.id = broadcast, number

    @property
    def ranks(self) -> dict[bytes, int]:
        return self._broadcast.value


def _share(docs: DataFrame, vocabulary: str) -> _Shared:
    ranks = read_ranks(vocabulary)  # read in the driver: executors need not have the file
    return _Shared(docs.sparkSession.sparkContext.broadcast(ranks), hash(frozenset(ranks.items())))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, tokens, round_trip), one row for each row of docs.

    tokens are the ids that the ranked merges give; round_trip says that decoding them gives the text's bytes back.
    A null text has null in all three; the empty text has no tokens. Texts of special tokens are ordinary text.
    Repeated rows are encoded each; a null id is carried; other columns are not read; texts of any length are
    encoded whole. An empty table gives an empty result. Narrow: no shuffle. The vocabulary's size is fixed.
    """
    shared = _share(docs, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                texts = batch.column(1)
                values, same = [], []
                for text in texts:
                    if text.is_valid:
                        ids = bpe.encode(text.as_py())
                        values.append(ids)
                        same.append(bpe.decode(ids.tolist()) == text.as_buffer().to_pybytes())
                    else:
                        values.append(np.empty(0, "<i4"))
                        same.append(None)
                null = np.array([s is None for s in same], dtype=bool)
                tokens = _lists(values)
                if null.any():
                    tokens = pa.ListArray.from_arrays(pa.array(np.asarray(tokens.offsets)[:-1].tolist() + [len(tokens.values)], pa.int32(), mask=np.append(null, False)), tokens.values)
                counts = pa.array([len(v) for v in values], pa.int32(), mask=null)
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, tokens, pa.array(same, pa.bool_())], [id_col, "n_tokens", "tokens", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, n_tokens int, tokens array<int>, round_trip boolean")


def bpe_decode(tokens: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, text), one row for each row of tokens. Null tokens give a null text, no tokens the empty one. Bytes that are no
    UTF-8 become U+FFFD; an id that the vocabulary lacks is an error. Repeated rows are decoded each, a null id is
    carried, other columns are not read, whatever their names. An empty table gives an empty result. Narrow."""
    shared = _share(tokens, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, tokens_col).mapInArrow(decode, f"`{id_col}` {kind}, text string")
