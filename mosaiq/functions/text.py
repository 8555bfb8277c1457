"""Text functions as Column expressions: cleaning, ids, hash vectors, prompts, display."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 29 code points that Unicode-aware stripping removes.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNIT = "\x1f"
SYSTEM_PROMPT = "Answer from the context that is given, and from nothing else. Where the context does not hold the answer, say: I don't know."
PROMPT_VERSION = "v1"
PROMPT_TEMPLATE = "Context:\n{context}\n\nQuestion: {question}{instructions_block}"
NO_CONTEXT = "[no retrieved context]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Line ends to LF, blanks to one space, line breaks to one, no blanks around breaks, stripped. Not idempotent."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{2,}", "\n")
    return strip(F.regexp_replace(c, " *\n *", "\n"))


def clean_extras(c: Column, strip_urls: bool = False, strip_emails: bool = False, lowercase: bool = False, line_patterns: tuple[str, ...] = ()) -> Column:
    """Optional steps before clean(): lines that match a header or footer pattern, URLs and addresses go; lower case."""
    for p in line_patterns:
        c = F.regexp_replace(c, f"(?m)^(?:{p})$\n?", "")
    if strip_urls:
        c = F.regexp_replace(c, r"https?://\S+|www\.\S+", "")
    if strip_emails:
        c = F.regexp_replace(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "")
    return F.lower(c) if lowercase else c


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    """SHA-256 of document, index and text; a null document counts as one without a name."""
    return F.sha2(F.concat(F.coalesce(document.cast("string"), F.lit("")), F.lit(UNIT), index.cast("string"), F.lit(UNIT), text), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def hash_vector(c: Column, dim: int = 12) -> Column:
    """dim numbers from -1 to 1 out of the text's SHA-256, its bytes taken round and round. No UDF."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    digest = F.sha2(c, 256)
    unit = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / F.lit(255.0) * 2.0 - 1.0 for i in range(min(dim, 32))]
    return F.when(c.isNotNull(), F.array(*[unit[i % 32] for i in range(dim)]))


def hash_vector_of(text: str, dim: int = 12) -> list[float]:
    """hash_vector of a driver-side text."""
    digest = hashlib.sha256(text.encode()).digest()
    return [(digest[i % 32] / 255.0) * 2.0 - 1.0 for i in range(dim)]


def py_str(c: Column, kind: T.DataType) -> Column:
    """c as Python's str() writes it; null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("string")
    d = c.cast("double")
    # the least number has a shorter spelling than the one that a cast gives
    plain, size = F.replace(d.cast("string"), F.lit("4.9E-324"), F.lit("5.0E-324")), F.abs(d)
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1).cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    two_digits = F.regexp_replace(F.abs(exponent).cast("string"), r"^(\d)$", "0$1")
    science = F.concat(mantissa, F.lit("e"), sign, two_digits)
    point = F.regexp_replace(F.regexp_replace(F.when((size >= 1e-5) & (size < 1e16), d).cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    return (
        F.when(F.isnan(d), "nan")
        .when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf"))
        .when((size == 0) | (size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e-4) & (size < 1e16), point)
        .otherwise(science)
    )


def truncate(c: Column, width: int = 140) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br />")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def split_context(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")


def int_or(c: Column, default: int | None = None) -> Column:
    """c as a whole number; default where it is null or not a number."""
    plain = F.when(~F.isnan(c.cast("double")), c).cast("bigint")
    return plain if default is None else F.coalesce(plain, F.lit(default))


def plain_context(texts: Column) -> Column:
    return F.array_join(texts, "\n\n")


def format_context(texts: Column) -> Column:
    """Numbered blocks of the texts, in order; a marker where there are none."""
    blocks = F.transform(texts, lambda t, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]\n"), t))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(blocks, "\n\n")).otherwise(NO_CONTEXT)


def user_prompt(question: Column, texts: Column, instructions: str | None = None, template: str | None = None) -> Column:
    """The template with {context}, {question} and {instructions_block} filled in, in one pass over the template."""
    block = f"\n\nAdditional instructions: {instructions.strip()}" if instructions else ""
    parts: dict[str, Column] = {"{context}": format_context(texts), "{question}": question, "{instructions_block}": F.lit(block)}
    rest, out = template or PROMPT_TEMPLATE, []
    while rest:
        at, name = min(((rest.find(k), k) for k in parts if k in rest), default=(-1, ""))
        if at < 0:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[:at]), parts[name]]
        rest = rest[at + len(name) :]
    return F.concat(*out)


def mock_response(question: Column, texts: Column, instructions: str | None = None) -> Column:
    n = F.coalesce(F.size(texts), F.lit(0))
    snippet = F.coalesce(F.translate(F.substring(F.get(texts, F.lit(0)), 1, 120), "\n", " "), F.lit(""))
    note = f" Instructions: {instructions.strip()}" if instructions else ""
    return F.concat(F.lit("[MOCK RESPONSE] Query: "), question, F.lit(". Chunks: "), n.cast("string"), F.lit(". Snippet: "), snippet, F.lit(f".{note}"))


def parse_duration(c: Column) -> Column:
    """Seconds of '90s', '5 m', '24h', '7D'; null for anything else."""
    pattern = r"^\s*(\d+)\s*([smhdSMHD])\s*$"
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1).try_cast("bigint") * scale)


def normal_model(model: str, provider: str) -> str:
    prefix = "openai/"
    return model[len(prefix) :] if provider in ("openai", "litellm") and model.startswith(prefix) and len(model) > len(prefix) else model
