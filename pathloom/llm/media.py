"""Media columns: texts as grey PNG images, and hashes of their low frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
LEVEL = 4
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """The rows of an 8-bit grey image after filter NONE, SUB or UP."""
    out = image.copy()
    if kind == SUB:
        out[:, 1:] -= image[:, :-1]
    elif kind == UP:
        out[1:] -= image[:-1]
    return out


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG. The whole image gets the filter with the least sum of absolute differences."""
    tries = {k: filtered(image, k) for k in (NONE, SUB, UP)}
    kind = min(tries, key=lambda k: (int(np.abs(tries[k].view(np.int8).astype(np.int16)).sum()), k))
    rows = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, tries[kind]
    data = zlib.compress(rows.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(
        b"IDAT",
        data[at : at + IDAT_BYTES],
    ) for at in range(0, len(data), IDAT_BYTES)) + chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, bytes) of each chunk; raises ValueError on a bad signature, length, checksum or end."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(body) != size or len(check) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, body
        at += 12 + size


def _by_diagonals(kind: int, part: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes AVERAGE or PAETH for rows below ``above``. A pixel needs those left, above and between, so all pixels of a diagonal go at once."""
    height, width = part.shape
    done = np.zeros((height + 1, width + 1), np.int16)
    done[0, 1:] = above
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            far_left, far_up, far_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up, corner))
        done[y + 1, x + 1] = (part[y, x] + guess) & 255
    return done[1:, 1:].astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undoes the filters of 8-bit grey rows, whose first column is the filter. Runs of rows of a filter go together."""
    kinds, raw = rows[:, 0], rows[:, 1:]
    height, width = raw.shape
    out = np.empty_like(raw)
    above = np.zeros(width, np.uint8)
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if height else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind, part = int(kinds[a]), raw[a:b]
        if kind == NONE:
            out[a:b] = part
        elif kind == SUB:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == UP:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (AVERAGE, PAETH):
            out[a:b] = _by_diagonals(kind, part, above)
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace, all chunks checked."""
    head, body = None, []
    for kind, some in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", some)
        elif kind == b"IDAT":
            body.append(some)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfilter(rows.reshape(head[1], head[0] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


SIDE = 32
_LOW = _cosines(SIDE, 8)


def _resample(a: np.ndarray, n: int) -> np.ndarray:
    """Area means of ``n`` equal parts along the first axis."""
    sums = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    at = np.arange(n + 1) * a.shape[0] / n
    low = np.minimum(at.astype(np.int64), a.shape[0])
    high = np.minimum(low + 1, a.shape[0])
    edge = sums[low] + (at - low)[:, None] * (sums[high] - sums[low])
    return np.diff(edge, axis=0) * n / a.shape[0]


def dct_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 image exceed their median (the constant one left out of it)."""
    small = _resample(_resample(image, SIDE).T, SIDE).T
    low = np.round(_LOW @ small @ _LOW.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


FIELDS = [
    ("n_bytes", T.LongType()),
    ("payload_bytes", T.LongType()),
    ("payload_sha256", T.StringType()),
    ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()),
    ("media_sha256", T.StringType()),
    ("feature", T.StringType()),
]


def store(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, PNG). The payload is the UTF-8 text, padded with zeros to a positive multiple of 64; a row of pixels is 64 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), encode_png(np.frombuffer(pad(raw), np.uint8).reshape(-1, WIDTH))


def features(png: bytes) -> tuple:
    """What is read back from a stored image: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    image = decode_png(png)
    payload = image.tobytes()
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        common.unsigned_crc(payload[-64:]),
        len(png),
        hashlib.sha256(png).hexdigest(),
        dct_hash(image),
    )


def _each(text_of):
    def task():
        def call(values):
            known: dict = {}
            for v in values:
                if v not in known:
                    known[v] = text_of(v)
            return [list(x) for x in zip(*[known[v] for v in values], strict=True)]

        return call

    return task


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``media``, a binary column with the PNG of each text, and ``n_bytes``. A null text counts as empty."""
    return common.extend(docs, [("n_bytes", T.LongType()), ("media", T.BinaryType())], [text_col], _each(store))


def read_features(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds what is read back from each image of a binary column: sizes, checksums and feature. Columns that clash are replaced."""
    return common.extend(stored, FIELDS[1:], [media_col], _each(features))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the sizes, checksums and feature of each text's image, which is stored and read back on the way.

    A null text counts as empty: 64 zero bytes. Equal texts get equal values. Columns that clash are replaced,
    and an empty table gives an empty result.
    """

    def both(text):
        n, png = store(text)
        return (n, *features(png))

    return common.extend(docs, FIELDS, [text_col], _each(both))
