"""Media columns: PNG files in binary columns, decoded and hashed by their low frequencies.

The decoder walks the chunks, tests each CRC, inflates the IDAT stream (Adler-32), undoes the row filters with numpy,
for many pictures together along their diagonals, and gives the samples. The hash is 64 bits, from the signs of the lowest 8 x 8 cosine-transform coefficients of the
picture reduced to 32 x 32, against their median; near pictures differ in few bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
SIDE, LOW = 32, 8
WIDTH = 64  # of rendered pages
_TOGETHER = 1 << 21  # bytes of pictures whose filters are undone together, or one picture
_DEFLATE = 1032  # bytes that a byte of a deflate stream can stand for, at most


class PngError(ValueError):
    pass


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise PngError("truncated")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise PngError("truncated")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise PngError("crc")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PngError("truncated")


def unfilter(raw: np.ndarray, rows: int, stride: int, bpp: int) -> np.ndarray:
    """uint8[rows, stride] from rows of a filter byte and stride bytes each."""
    return _unfiltered([raw[: rows * (stride + 1)].reshape(rows, stride + 1)], bpp)[0]


def _unfiltered(pictures: list[np.ndarray], bpp: int) -> list[np.ndarray]:
    """Lines without filters of pictures (rows of a filter byte and as many bytes in each) of one stride.

    A pixel depends on those to its left, above and above left, so the pixels of a diagonal, in all rows and pictures,
    are done at once: step t has the pixels t - r of rows r. In the table, pixels of a row follow one another, the rows
    too, with a row and a column of zeros before them; so a diagonal is a slice with a step.
    """
    n, height, stride = len(pictures), max(len(x) for x in pictures), pictures[0].shape[1] - 1
    across = -(-stride // bpp)
    wide = across + 1
    table = np.zeros((height + 1, wide, n, bpp), dtype=np.int16)
    kinds = np.zeros((height, n), dtype=np.int16)
    for k, x in enumerate(pictures):
        kinds[: len(x), k] = x[:, 0]
        padded = np.pad(x[:, 1:], ((0, 0), (0, across * bpp - stride)))
        table[1 : len(x) + 1, 1:, k] = padded.reshape(len(x), across, bpp)
    if kinds.max(initial=0) > 4:
        raise PngError("filter")
    flat, kinds = table.reshape(-1, n * bpp), np.repeat(kinds, bpp, axis=1)
    one, two, three, four = (kinds == k for k in (1, 2, 3, 4))
    for t in range(height + across - 1):
        low, high = max(0, t - across + 1), min(height, t + 1)
        first, last = (low + 1) * wide + t - low + 1, high * wide + t - high + 2
        rows = slice(low, high)
        a, b, c = (flat[first - d : last - d + 1 : across] for d in (1, wide, wide + 1))
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - c - c)
        guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess *= four[rows]
        guess += a * one[rows]
        guess += b * two[rows]
        guess += ((a + b) >> 1) * three[rows]
        now = flat[first : last + 1 : across]
        now += guess
        now &= 255
    return [table[1 : len(x) + 1, 1:, k].reshape(len(x), across * bpp)[:, :stride].astype(np.uint8) for k, x in enumerate(pictures)]


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 8:
        return lines[:, : width * channels].reshape(len(lines), width, channels)
    if depth == 16:
        return np.ascontiguousarray(lines[:, : 2 * width * channels]).view(">u2").reshape(len(lines), width, channels)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8))[:, :, None].astype(np.uint8)


_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))  # x, y, steps


def _parsed(data: bytes) -> tuple:
    """(header, palette, transparency, [(x, y, dx, dy, width, lines with filters)]) of a file whose tests pass."""
    header, palette, alpha, parts = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise PngError("header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            if len(body) % 3 or not body:
                raise PngError("palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            parts.append(body)
    if header is None:
        raise PngError("header")
    width, height, depth, color, compression, method, interlace = header
    if color not in _CHANNELS or depth not in _DEPTHS[color] or compression or method or interlace > 1 or not width or not height:
        raise PngError("header")
    bits = depth * _CHANNELS[color]
    passes = _ADAM7 if interlace else ((0, 0, 1, 1),)
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    strides = [-(-w * bits // 8) for w, _ in sizes]
    need = sum(h * (s + 1) for (w, h), s in zip(sizes, strides) if w > 0 and h > 0)
    packed = b"".join(parts)
    if need > _DEFLATE * len(packed):  # before anything of that size is made
        raise PngError("zlib")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(packed, need + 1)
        if len(raw) == need and not inflate.eof:
            raw += inflate.decompress(inflate.unconsumed_tail, 1)
    except zlib.error as e:
        raise PngError("zlib") from e
    if len(raw) != need or not inflate.eof:
        raise PngError("zlib")
    flat, at, lines = np.frombuffer(raw, np.uint8), 0, []
    for (x, y, dx, dy), (w, h), stride in zip(passes, sizes, strides):
        if w > 0 and h > 0:
            lines.append((x, y, dx, dy, w, flat[at : at + h * (stride + 1)].reshape(h, stride + 1)))
            if lines[-1][-1][:, 0].max() > 4:
                raise PngError("filter")
            at += h * (stride + 1)
    return header, palette, alpha, lines


def _luma(header: tuple, palette: np.ndarray | None, alpha: bytes | None, passes: list[tuple]) -> np.ndarray:
    width, height, depth, color = header[:4]
    channels = _CHANNELS[color]
    picture = np.zeros((height, width, channels), dtype=np.uint16 if depth == 16 else np.uint8)
    for x, y, dx, dy, w, lines in passes:
        picture[y::dy, x::dx] = _samples(lines, w, depth, channels)
    if color == 3:
        if palette is None or picture.max() >= len(palette):
            raise PngError("palette")
        opaque = np.full(len(palette), 255, dtype=np.float32)
        if alpha is not None:
            given = np.frombuffer(alpha, np.uint8)[: len(opaque)]
            opaque[: len(given)] = given
        cover = opaque[picture[:, :, 0]] / 255
        rgb = palette[picture[:, :, 0]].astype(np.float32)
    else:
        values = picture.astype(np.float32) * np.float32(255 / ((1 << depth) - 1))
        cover = values[:, :, -1] / 255 if color in (4, 6) else None
        rgb = values[:, :, :3] if color in (2, 6) else values[:, :, :1]
        if alpha is not None and color in (0, 2):  # the one colour that is transparent
            if len(alpha) != 2 * channels:
                raise PngError("transparency")
            clear = np.frombuffer(alpha, ">u2") & ((1 << depth) - 1)
            cover = 1 - (picture == clear).all(axis=2).astype(np.float32)
    luma = rgb @ np.array([0.299, 0.587, 0.114], np.float32) if rgb.shape[2] == 3 else rgb[:, :, 0]
    return luma if cover is None else luma * cover + 255 * (1 - cover)


def decoded(files: list[bytes]) -> list[np.ndarray | PngError]:
    """For each file its float32[height, width], luma from 0 to 255, alpha over white; or the test that it failed."""
    out: list = []
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for i, data in enumerate(files):
        try:
            out.append(_parsed(data))
        except PngError as e:
            out.append(e)
            continue
        bpp = max(1, out[i][0][2] * _CHANNELS[out[i][0][3]] // 8)
        for j, (*_, lines) in enumerate(out[i][3]):
            groups.setdefault((lines.shape[1], bpp, len(lines).bit_length()), []).append((i, j))
    for (_, bpp, _), members in groups.items():
        step = max(1, _TOGETHER // max(out[i][3][j][-1].size for i, j in members))
        for low in range(0, len(members), step):
            some = members[low : low + step]
            for (i, j), plain in zip(some, _unfiltered([out[i][3][j][-1] for i, j in some], bpp)):
                out[i][3][j] = (*out[i][3][j][:-1], plain)
    for i, x in enumerate(out):
        if not isinstance(x, PngError):
            try:
                out[i] = _luma(*x)
            except PngError as e:
                out[i] = e
    return out


def decode(data: bytes) -> np.ndarray:
    """float32[height, width], luma from 0 to 255; alpha over white. Raises PngError if the file is damaged."""
    (got,) = decoded([data])
    if isinstance(got, PngError):
        raise got
    return got


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE)).astype(np.float32)


def _reduced(picture: np.ndarray) -> np.ndarray:
    """Means over SIDE equal stretches of the first axis; what lies on a border is shared by area."""
    n = len(picture)
    sums = np.zeros((n + 1, picture.shape[1]), dtype=np.float64)
    np.cumsum(picture, axis=0, dtype=np.float64, out=sums[1:])
    edges = np.arange(SIDE + 1) * n / SIDE
    whole = np.minimum(edges.astype(int), n - 1)
    at = sums[whole] + picture[whole] * (edges - whole)[:, None]
    return (np.diff(at, axis=0) / (n / SIDE)).astype(np.float32)


def low_frequency_hash(luma: np.ndarray) -> bytes:
    """8 bytes: bit i says whether coefficient i of the lowest 8 x 8 is above their median (the mean term left out)."""
    small = _reduced(_reduced(luma).T).T
    c = _cosines()
    low = (c @ small @ c.T).ravel()
    return np.packbits(low > np.median(low[1:]) + 1e-4).tobytes()


def _encode(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG whose rows take the five filters in turn."""
    h, w = pixels.shape
    left, up, corner = (np.zeros_like(pixels) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = pixels[:, :-1], pixels[:-1], pixels[:-1, :-1]
    rows = np.zeros((h, w + 1), dtype=np.uint8)
    rows[:, 0] = np.arange(h) % 5
    for kind in range(5):
        x, a, b, c = (m[kind::5].astype(np.int16) for m in (pixels, left, up, corner))
        p = a + b - c
        da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        guess = (0, a, b, (a + b) >> 1, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)))[kind]
        rows[kind::5, 1:] = (x - guess).astype(np.uint8)
    packed = zlib.compress(rows.tobytes(), 1)
    half = len(packed) // 2
    out = [SIGNATURE]
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", packed[:half]), (b"IDAT", packed[half:]), (b"IEND", b"")):
        out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return b"".join(out)


def render(content: bytes, width: int = WIDTH) -> bytes:
    """A PNG that shows bytes as grey pixels, width to a row; the last row is filled with zeros. At least one row."""
    rows = max(1, -(-len(content) // width))
    return _encode(np.frombuffer(content.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width))


def _each(batches: Iterator[pa.RecordBatch], make, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """make: from the files of some rows to as many tuples of results. A null has nulls."""
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            there = [i for i, x in enumerate(batch.column(1)) if x.is_valid]
            got: list[tuple] = [(None,) * len(kinds)] * batch.num_rows
            for i, x in zip(there, make([batch.column(1)[i].as_buffer().to_pybytes() for i in there])):
                got[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names)


def render_pages(pages: DataFrame, id_col: str = "page_id", content_col: str = "html") -> DataFrame:
    """(id, image), one row for each row of pages: its whole content as a PNG. A null content gives a null image, an empty
    one a picture of one row of zeros. Repeated rows get a picture each, a null id is carried, other columns are not
    read, whatever their names. An empty table gives an empty result. Narrow."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(content_col).cast("binary")).mapInArrow(lambda it: _each(it, lambda files: [(render(x),) for x in files], [id_col, "image"], [pa.binary()]), f"`{id_col}` {kind}, image binary")


def _look(files: list[bytes]) -> list[tuple]:
    return [
        (None, None, None, None, str(x)) if isinstance(x, PngError) else (x.shape[1], x.shape[0], float(x.mean(dtype=np.float64)), low_frequency_hash(x), None)
        for x in decoded(files)
    ]


def png_hashes(images: DataFrame, id_col: str = "page_id", image_col: str = "image") -> DataFrame:
    """(id, width, height, mean, hash, error), one row for each row of images; hash is binary, 8 bytes.

    A file that fails a test (signature, header, crc, zlib, filter, palette, transparency, truncated) has the test's
    name as error and null elsewhere; a null image has null everywhere; empty bytes fail the signature. Pictures of any
    size are decoded; a header that claims more than its data can hold fails zlib before memory is taken. Repeated rows
    get the same answer each; a null id is carried; other columns are not read. An empty table gives an empty result.
    Narrow.
    """
    kind = images.schema[id_col].dataType.simpleString()
    names = [id_col, "width", "height", "mean", "hash", "error"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.string()]
    return images.select(id_col, image_col).mapInArrow(lambda it: _each(it, _look, names, kinds), f"`{id_col}` {kind}, width int, height int, mean double, hash binary, error string")
