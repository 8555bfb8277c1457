"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
#: A stretch in which numbers can stand; the patterns below are tried only inside such stretches.
_NUMERIC = re.compile(r"[+(]?[0-9][0-9 ().+\-]*[0-9]")
_IPV4 = re.compile(r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])")
_PHONE = re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])")
_PHONE_INTL = re.compile(r"\+[1-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])")
_CARD = re.compile(r"(?<![0-9])[2-6][0-9]{3}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}(?![0-9])")
#: Numbers that issuers give out, by their first digits and length; where proposals overlap, these go before others.
_ISSUED = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|220[0-4][0-9]{12,15}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35[2-8][0-9]{13,16}|(?:5[06-8]|6[0-9])[0-9]{11,17}")
_SSN = re.compile(r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])")
_SSN_GOES_ON, _IPV4_GOES_ON = re.compile(r"[0-9\-]"), re.compile(r"[0-9]|\.[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Length of each country's IBANs (ISO 13616); of others any length is taken.
_IBAN_LENGTH = {
    c: int(n)
    for n, countries in (x.split(":") for x in "15:NO 16:BE 18:DK FO FI GL NL SD 19:MK SI 20:AT BA EE KZ LT LU MN XK 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL IQ OM SO TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:LY PT ST 26:IS TR 27:BI DJ FR GR IT MC MR SM 28:AL AZ BY CY DO GT HU LB NI PL SV 29:BR PS QA UA 30:JO KW MU YE 31:MT SC 32:LC 33:RU".replace(" ", ",").replace(",1", " 1").replace(",2", " 2").replace(",3", " 3").split())
    for c in countries.split(",")
}

#: Score of a span by its pattern alone; what a passed checksum adds; a failed one rejects the span.
BASE = {"email": 0.9, "ipv4": 0.6, "phone": 0.6, "card": 0.3, "ssn": 0.5, "iban": 0.3}
CHECKSUM = 0.5
NEAR = 40  # characters on either side in which context words count
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|correo|courriel",
    "ipv4": r"ip|address|host|server|login|adresse|direcci[oó]n",
    "phone": r"phone|tel|call|fax|mobile|cell|t[eé]l[eé]phone|telefon|tel[eé]fono|whatsapp",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|carte|karte|tarjeta",
    "ssn": r"ssn|social security",
    "iban": r"iban|bank|account|konto|compte|cuenta",
}
AGAINST = {
    "ipv4": r"version|release|build|chapter|section",
    "phone": r"isbn|order|invoice|serial",
    "card": r"isbn|order|serial|tracking",
    "ssn": r"isbn|order|serial|part",
}
STEP = 0.2
THRESHOLD = 0.5
_FOR = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])", re.I) for k, v in CONTEXT.items()}
_NOT = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])", re.I) for k, v in AGAINST.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters become 10 to 35, the number is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        low = at  # the local part is all that can belong to one, however long
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        right = _EMAIL_RIGHT.match(text, at + 1) if low < at and text[at - 1] != "." else None
        if right:
            free = right.end()
            yield low, free
        at = text.find("@", max(at + 1, free))


def _iban(text: str) -> Iterator[tuple[int, int]]:
    """Spans whose longest prefix of whole groups has the country's length and passes mod 97: the pattern may run on into
    capitals that follow."""
    for m in _IBAN.finditer(text):
        a, b = m.span()
        length = _IBAN_LENGTH.get(text[a : a + 2])
        while b - a >= 15:
            if text[b - 1] != " " and (b == len(text) or not text[b].isalnum()):
                whole = text[a:b].replace(" ", "")
                if length in (None, len(whole)) and mod97(whole):
                    yield a, b
                    break
            b -= 1


def _cards(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Spans in text[low:high] that pass Luhn, from every group of digits on: a year or a house number before a card
    may look like its first group. Spans may overlap, but not with one whose number is an issuer's if theirs isn't."""
    passed, m = [], _CARD.search(text, low, high)
    while m:
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            passed.append((*m.span(), bool(_ISSUED.fullmatch(digits))))
        m = _CARD.search(text, m.start() + 1, high)
    for i, (a, b, issued) in enumerate(passed):
        # a span is 22 characters at most and begins a group, so few are near enough to overlap
        near = passed[max(0, i - 11) : i + 12]
        if issued or not any(other and x < b and a < y for x, y, other in near):
            yield a, b


def spans(text: str) -> list[tuple[str, int, int, bool | None, float]]:
    """(kind, start, end, checksum passed or None, score) in code points, by start; spans don't overlap."""
    found: list[tuple[str, int, int, bool | None]] = [("email", a, b, None) for a, b in _emails(text)]
    found += [("iban", a, b, True) for a, b in _iban(text)]
    for region in _NUMERIC.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        found += [("card", *x, True) for x in _cards(text, a, b)]
        # what must not follow a number is looked for beyond the region, too
        found += [("ssn", *m.span(), None) for m in _SSN.finditer(text, a, b) if not _SSN_GOES_ON.match(text, m.end())]
        found += [("ipv4", *m.span(), None) for m in _IPV4.finditer(text, a, b) if not _IPV4_GOES_ON.match(text, m.end())]
        found += [("phone", *m.span(), None) for m in _PHONE.finditer(text, a, b)]
        for m in _PHONE_INTL.finditer(text, a, b):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span(), None))
    out, free = [], 0
    for kind, a, b, passed in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if a < free:
            continue
        score = BASE[kind] + (CHECKSUM if passed else 0)
        near = f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}"
        score += STEP * bool(_FOR[kind].search(near)) - STEP * bool(kind in _NOT and _NOT[kind].search(near))
        if score >= THRESHOLD:
            out.append((kind, a, b, passed, round(min(1.0, max(0.0, score)), 3)))
            free = b
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, kind, start, end, checksum_ok, score) for each span of personal data; offsets in code points.

    Narrow: no shuffle, Arrow batches. Cards and IBANs that fail their checksum are no findings; kinds without a
    checksum have checksum_ok null. Null and empty texts give no rows; a null id is carried; repeated rows give
    their findings once each; of spans that overlap the one that starts first counts, then the longest, but a card
    number that no issuer gives out yields to one of an issuer; other columns are not read. Texts of any length are searched whole. An empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for row in spans(text.as_py()) if text.is_valid else ():
                    at.append(i)
                    rows.append(row)
            kind, a, b, passed, score = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(passed, pa.bool_()), pa.array(score, pa.float64())],
                [id_col, "kind", "start", "end", "checksum_ok", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, kind string, start int, end int, checksum_ok boolean, score double")
