"""Secret scan with one combined deterministic automaton.

Rule regexes are parsed, turned into byte NFAs, combined, made deterministic by subset construction and
minimised into one transition array. A document is scanned once, byte by byte, for all rules together. Where
the combined automaton accepts, small per-rule automata give the span: the reversed one walks back to the
leftmost start, the forward one on to the longest end. Of some rules it has a part only (HEADS).

Rule syntax: literals, escapes, classes, (?:...) groups, |, ?, *, +, {m}, {m,n}, {m,}, a leading (?i), and \\b
as the first or last item. All of it means what it means in RE2 over UTF-8: ., negated classes and \\D, \\W, \\S take
a whole character, whatever its number of bytes; a negated class may name ASCII characters only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Published token formats. Bodies are bounded below only where an upper bound would multiply states.
RULES: dict[str, str] = {
    "assigned_secret": r"""(?i)\b[0-9a-z_]*(?:token|secret|passwd|password|api_?key|access_?key)["']?[ \t]{0,3}(?:=|:|=>)[ \t]{0,3}["'][0-9a-z_+/=.\-]{16,}["']""",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9]{8,}-[0-9A-Za-z\-]+",
    "google_api_key": r"\bAIza[0-9A-Za-z_\-]{35}",
    "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "json_web_token": r"\beyJ[0-9A-Za-z_]{10,}\.eyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----",
    "url_password": r"\b(?:postgres|postgresql|mysql|mongodb|redis|amqp|https?)://[0-9A-Za-z_]+:[0-9A-Za-z_!$%&*+.\-]+@",
}

#: Beginnings of rules whose bodies hold bytes at which other rules begin, and how the beginnings end: in the combined
#: automaton the states of such rules would multiply. It looks for the end, and the rule's own automata do the rest.
HEADS: dict[str, tuple[str, str]] = {
    "assigned_secret": (RULES["assigned_secret"].removesuffix(r"""[0-9a-z_+/=.\-]{16,}["']"""), r"""[=:>][ \t]{0,3}["']"""),
    "google_api_key": (r"\bAIza", r"\bAIza"),
}

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_NONWORD = frozenset(range(256)) - _WORD
_EDGE = 0xFF  # never occurs in UTF-8; stands before and after each text
_ASCII = frozenset(range(128))
_CLASS = {"d": frozenset(b"0123456789"), "w": _WORD, "s": frozenset(b" \t\n\r\f")}
_TAIL = ("set", frozenset(range(0x80, 0xC0)))
#: The characters beyond ASCII, as sequences of bytes.
_WIDE = [("cat", ("set", frozenset(range(low, high))), *[_TAIL] * n) for low, high, n in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3))]
_PIECE = 256  # bytes that are read at a time around a hit
_CTRL = {"n": 10, "t": 9, "r": 13, "f": 12}


class _Parser:
    """Regex text to a tree: ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, m, n or None), ('b',)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.s, self.i = pattern[4:] if self.fold else pattern, 0

    def parse(self):
        tree = self._alt()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return tree

    def _peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def _alt(self):
        options = [self._cat()]
        while self._peek() == "|":
            self.i += 1
            options.append(self._cat())
        return options[0] if len(options) == 1 else ("alt", *options)

    def _cat(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated())
        return ("cat", *items)

    def _repeated(self):
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i + 1 : end].partition(",")
                node, self.i = ("rep", node, int(low), (int(high) if high else None) if comma else int(low)), end + 1
            else:
                node, self.i = ("rep", node, int(c == "+"), 1 if c == "?" else None), self.i + 1
        return node

    def _set(self, members: frozenset[int], others: bool = False):
        """One of the characters; others: or any that is not ASCII."""
        if self.fold:
            members = members | {b ^ 32 for b in members if 65 <= b & ~32 <= 90 and b < 128}
        wide = [("cat", *(("set", frozenset([b])) for b in chr(c).encode())) for c in sorted(members) if c > 127]
        options = [("set", frozenset(c for c in members if c < 128)), *wide, *(_WIDE if others else [])]
        return options[0] if len(options) == 1 else ("alt", *options)

    def _escape(self) -> tuple[frozenset[int], bool]:
        """(characters, whether those that are not ASCII belong to them)."""
        c = self.s[self.i]
        self.i += 1
        if c in "DWS":
            return _ASCII - _CLASS[c.lower()], True
        return _CLASS.get(c) or frozenset([_CTRL.get(c, ord(c))]), False

    def _atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self._alt()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            return node
        if c == "\\":
            if self._peek() == "b":
                self.i += 1
                return ("b",)
            return self._set(*self._escape())
        if c == ".":
            return self._set(_ASCII - {10}, True)
        if c == "[":
            negate = self._peek() == "^"
            self.i += negate
            members: set[int] = set()
            others = False
            while self._peek() != "]":
                c = self.s[self.i]
                self.i += 1
                one, beyond = self._escape() if c == "\\" else (frozenset([ord(c)]), False)
                if self._peek() == "-" and self.s[self.i + 1] != "]" and len(one) == 1:
                    self.i += 1
                    c = self.s[self.i]
                    self.i += 1
                    high = min(self._escape()[0]) if c == "\\" else ord(c)
                    one = frozenset(range(min(one), high + 1))
                members |= one
                others |= beyond
            self.i += 1
            if not negate:
                return self._set(frozenset(members), others)
            if max(members) > 127:
                raise ValueError(f"a negated class of {self.s!r} has characters beyond ASCII")
            folded = members | ({b ^ 32 for b in members if 65 <= b & ~32 <= 90} if self.fold else set())
            return ("alt", ("set", _ASCII - folded), *([] if others else _WIDE))
        if c in ")?*+{":
            raise ValueError(f"unexpected {c!r} in {self.s!r}")
        return self._set(frozenset([ord(c)]))


def _body(pattern: str) -> tuple[bool, tuple, bool]:
    """Whether \\b leads, the tree without \\b at its ends, whether \\b trails."""
    tree = _Parser(pattern).parse()
    items = list(tree[1:]) if tree[0] == "cat" else [tree]
    lead, trail = items[:1] == [("b",)], items[1:] and items[-1] == ("b",)
    return lead, ("cat", *items[int(lead) : len(items) - int(bool(trail))]), bool(trail)


def _reverse(node):
    if node[0] == "cat":
        return ("cat", *(_reverse(x) for x in reversed(node[1:])))
    if node[0] == "alt":
        return ("alt", *(_reverse(x) for x in node[1:]))
    if node[0] == "rep":
        return ("rep", _reverse(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def add(self, node, at: int) -> int:
        """Add node's automaton after state at; its last state."""
        if node[0] == "set":
            to = self.state()
            self.arcs[at].append((node[1], to))
            return to
        if node[0] == "cat":
            for x in node[1:]:
                at = self.add(x, at)
            return at
        if node[0] == "alt":
            end = self.state()
            for x in node[1:]:
                start = self.state()
                self.eps[at].append(start)
                self.eps[self.add(x, start)].append(end)
            return end
        if node[0] == "rep":
            _, inner, low, high = node
            for _ in range(low):
                at = self.add(inner, at)
            if high is None:
                start = self.state()
                self.eps[at].append(start)
                end = self.add(inner, start)
                self.eps[end].append(start)
                return start
            end = self.state()
            for _ in range(high - low):
                self.eps[at].append(end)
                at = self.add(inner, at)
            self.eps[at].append(end)
            return end
        raise ValueError("\\b is supported at the ends of a rule only")


class Dfa:
    """Minimised automaton: step[state * width + class], accepts[state] = bit mask of rules, kind[byte] = class."""

    def __init__(self, trees: list[tuple], search: bool, limit: int = 200_000):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for rule, tree in enumerate(trees):
            start = nfa.state()
            nfa.eps[root].append(start)
            end = nfa.add(tree, start)
            final[end] = final.get(end, 0) | 1 << rule
        distinct = {members for arcs in nfa.arcs for members, _ in arcs}
        keys = [tuple(b in members for members in distinct) for b in range(256)]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        self.kind = bytes(number[k] for k in keys)
        width = len(number)
        sample = {c: b for b, c in enumerate(self.kind)}

        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for to in nfa.eps[todo.pop()]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(x for x in seen if nfa.arcs[x] or x in final)

        base = closure([root])
        names, order, rows = {base: 0}, [base], []
        for states in order:  # grows while it is walked
            row = []
            for c in range(width):
                b = sample[c]
                after = closure([to for x in states for members, to in nfa.arcs[x] if b in members])
                after = after | base if search else after
                if after not in names:
                    names[after] = len(order)
                    order.append(after)
                    if len(order) > limit:
                        raise ValueError(f"the rules need over {limit} states")
                row.append(names[after])
            rows.append(row)
        accept = [0] * len(order)
        for i, states in enumerate(order):
            for x in states:
                accept[i] |= final.get(x, 0)
        table = np.array(rows, dtype=np.int64)
        _, block = np.unique(np.array(accept, dtype=object).astype(str), return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        first = np.unique(block, return_index=True)[1]
        ranked = sorted(range(len(first)), key=lambda b: (accept[first[b]] != 0, first[b]))  # accepting states last
        place = np.empty(len(first), dtype=np.int64)
        place[ranked] = np.arange(len(first))
        self.states, self.width = len(first), width
        self.step = (place[block[table[first[ranked]]]] * width).ravel().tolist()
        self.accepts = [accept[first[b]] for b in ranked]
        self.start = int(place[block[0]]) * width
        self.accepting = next((i for i, a in enumerate(self.accepts) if a), len(first)) * width

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(index of the last byte, mask of rules) wherever some rule's match ends."""
        step, s, accepting, found = self.step, self.start, self.accepting, []
        for i, c in enumerate(data.translate(self.kind)):
            s = step[s + c]
            if s >= accepting:
                found.append((i, s))
        return [(i, self.accepts[s // self.width]) for i, s in found]

    def furthest(self, pieces: Iterator[bytes]) -> int:
        """Length of the longest prefix of the pieces together that is accepted, -1 if none is."""
        step, s, best = self.step, self.start, 0 if self.start >= self.accepting else -1
        dead, n = self._dead, 0
        for piece in pieces:
            for i, c in enumerate(piece.translate(self.kind), n + 1):
                s = step[s + c]
                if s >= self.accepting:
                    best = i
                elif s == dead:
                    return best
            n += len(piece)
        return best

    @property
    def _dead(self) -> int:
        w = self.width
        return next((i * w for i in range(self.states) if i * w < self.accepting and all(t == i * w for t in self.step[i * w : i * w + w])), -1)


def _onwards(data: bytes, low: int) -> Iterator[bytes]:
    """data[low:] in pieces."""
    for i in range(low, len(data), _PIECE):
        yield data[i : i + _PIECE]


def _backwards(data: bytes, low: int, high: int) -> Iterator[bytes]:
    """data[low:high] in pieces from its end, each reversed."""
    for i in range(high, low, -_PIECE):
        yield data[max(low, i - _PIECE) : i][::-1]


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.names = list(rules)
        parts = [_body(p) for p in rules.values()]
        edge = ("set", _NONWORD)
        self.lead, self.trail = [p[0] for p in parts], [p[2] for p in parts]
        full = [("cat", *([edge] if lead else []), body, *([edge] if trail else [])) for lead, body, trail in parts]
        heads, ends = list(full), list(full)
        for i, (n, p) in enumerate(rules.items()):
            if p == RULES.get(n) and n in HEADS:
                heads[i], ends[i] = (("cat", *([edge] if lead else []), body) for lead, body, _ in map(_body, HEADS[n]))
        self.all = Dfa(ends, search=True)
        self.forward = [Dfa([t], search=False) for t in full]
        self.backward = [Dfa([_reverse(t)], search=False) for t in heads]

    def scan(self, text: bytes) -> list[tuple[str, int, int]]:
        """(rule, start, end) byte spans. Of a rule's matches the one that ends first counts, back to its leftmost
        start and on to its longest end; the next one may not overlap it. A rule in HEADS is tried
        wherever its beginning ends."""
        data = b"\xff" + text + b"\xff"
        out, free = [], [0] * len(self.names)
        for last, mask in self.all.hits(data):
            for r in range(len(self.names)):
                if not mask >> r & 1 or last < free[r]:
                    continue
                low = max(0, free[r] - 1) if self.lead[r] else free[r]
                back = self.backward[r].furthest(_backwards(data, low, last + 1))
                if back < 0:
                    continue
                begin = last + 1 - back
                ahead = self.forward[r].furthest(_onwards(data, begin))
                if ahead < 0:
                    continue  # a beginning without the rest
                end = begin + ahead
                body = (begin + self.lead[r], end - self.trail[r])
                out.append((self.names[r], body[0] - 1, body[1] - 1))
                free[r] = body[1]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=4)
def _scanner(rules: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(rules))


def secret_scan(docs: DataFrame, rules: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, rule, start_byte, end_byte, sha256 of the match) for each secret in docs.

    Narrow: no shuffle; the automaton is compiled once, in the driver, and travels with the function. Null and empty
    texts give no rows. Repeated rows give their findings once each. A null id is carried as it is. Other columns
    of docs are not read, whatever their names. An empty table gives an empty result. Matches are found wherever
    they stand in a text of any length.
    """
    scanner = _scanner(tuple((rules or RULES).items()))  # a bad rule fails here, in the driver

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    data = text.as_buffer().to_pybytes()
                    for rule, a, b in scanner.scan(data):
                        at.append(i)
                        rows.append((rule, a, b, hashlib.sha256(data[a:b]).hexdigest()))
            rule, a, b, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rule, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())],
                [id_col, "rule", "start_byte", "end_byte", "sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, rule string, start_byte bigint, end_byte bigint, sha256 string")


def oracle(rules: dict[str, str] | None = None) -> str:
    """DuckDB SQL for secret_scan over documents."""
    values = ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in (rules or RULES).items())
    return f"""
WITH rules(rule, pat) AS (VALUES {values}),
m AS (SELECT doc_id, rule, regexp_extract_all(text, pat) AS ms, regexp_split_to_array(text, pat) AS ps
      FROM documents, rules WHERE regexp_matches(text, pat)),
e AS (SELECT doc_id, rule, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT doc_id, rule,
       (list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: strlen(x))), 0))::BIGINT AS start_byte,
       (list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + list_sum(list_transform(ms[1:i], lambda x: strlen(x))))::BIGINT AS end_byte,
       sha256(ms[i]) AS sha256
FROM e"""
