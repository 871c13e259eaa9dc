"""Media columns: payload bytes stored as 8-bit greyscale PNG, read back, and hashed by low cosine frequencies.

Only zlib and numpy are used. The reader tests the signature, every chunk's checksum and the sizes,
and undoes all five row filters of the format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, picked

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, FILL = 576, 255
#: Bytes of one IDAT chunk, and zlib's effort.
IDAT, EFFORT = 1 << 20, 3


class MediaError(ValueError):
    """Stored bytes that are not what the writer produced."""


def padded(text: str | None) -> tuple[bytes, int]:
    """(payload, unpadded length): UTF-8 with bytes 255 appended up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return raw + bytes([FILL]) * (rows * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(payload: bytes, width: int = WIDTH, effort: int = EFFORT) -> bytes:
    """A greyscale PNG of rows of `width` samples. Of unfiltered rows and rows each under the filter of least
    absolute sum (none, left or above) the stream that compresses better is kept."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be whole rows")
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    plain = zlib.compress(np.concatenate([np.zeros((len(x), 1), np.uint8), x], 1).tobytes(), effort)
    left, above = x.copy(), x.copy()
    left[:, 1:] -= x[:, :-1]
    above[1:] -= x[:-1]
    options = np.stack([x, left, above])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    kind = cost.argmin(0).astype(np.uint8)
    picked_rows = options[kind, np.arange(len(x))]
    tuned = zlib.compress(np.concatenate([kind[:, None], picked_rows], 1).tobytes(), effort) if kind.any() else plain
    data = min(plain, tuned, key=len)
    head = struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """Samples [rows, width] of an 8-bit greyscale PNG; MediaError if anything does not hold."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("cut short")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", crc)[0]:
            raise MediaError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
                raise MediaError("not plain 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not size or not ended:
        raise MediaError("no header or end")
    width, height = size
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if raw.size != height * (width + 1):
        raise MediaError("wrong number of samples")
    raw = raw.reshape(height, width + 1)
    return unfiltered(raw[:, 0], raw[:, 1:])


def unfiltered(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters none, left, above, average and Paeth (one byte a sample)."""
    if kind.size and kind.max() > 4:
        raise MediaError("unknown row filter")
    out = np.array(rows, np.uint8)
    left = kind == 1
    if left.any():
        out[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    at = 0
    later = np.flatnonzero(kind >= 2)
    while at < len(later):
        first = later[at]
        if kind[first] == 2:  # a run of rows that each add the row above: one running sum
            last = at
            while last + 1 < len(later) and later[last + 1] == later[last] + 1 and kind[later[last + 1]] == 2:
                last += 1
            end = later[last] + 1
            out[first:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)
            if first:
                out[first:end] += out[first - 1]
            at = last + 1
            continue
        above = out[first - 1].astype(int) if first else np.zeros(out.shape[1], int)
        a = c = 0
        for j, x in enumerate(rows[first].tolist()):
            b = int(above[j])
            if kind[first] == 3:
                a = (x + (a + b) // 2) & 255
            else:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                a = (x + near) & 255
            c = b
            out[first, j] = a
        at += 1
    return out


def _cosines(n: int, low: int) -> np.ndarray:
    k = np.arange(low)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


_GRID, _LOW = 32, 8
_DCT = _cosines(_GRID, _LOW)


def cosine_hash(x: np.ndarray) -> str:
    """64 bits as hex: which of the lowest 8 x 8 cosine coefficients of the 32 x 32 mean image lie above their median."""
    for axis in (0, 1):
        n = x.shape[axis]
        if n >= _GRID:
            cut = np.arange(_GRID + 1) * n // _GRID
            x = np.add.reduceat(x, cut[:-1], axis=axis, dtype=np.float64) / np.diff(cut).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            x = np.take(x, np.arange(_GRID) * n // _GRID, axis=axis).astype(np.float64)
    c = np.round(_DCT @ x @ _DCT.T, 4).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a PNG in a binary column. A null text is empty (one row of fill)."""

    def rows(b: pa.RecordBatch) -> dict:
        sizes, media = [], []
        for t in b.column("text").to_pylist():
            payload, n = padded(t)
            sizes.append(n)
            media.append(write_png(payload))
        return {"doc_id": b.column("doc_id"), "n_bytes": sizes, "media": media}

    return arrow_map(picked(docs, doc_id=id_col, text=text_col), rows, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back and describes them: payload size and digests, and the cosine hash.

    Null media give null features; damaged media raise MediaError. One row in, one row out, in any order;
    equal media give equal values; no shuffle.
    """

    def rows(b: pa.RecordBatch) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        found = []
        for m in b.column("media").to_pylist():
            if m is None:
                found.append((None,) * len(names))
                continue
            x = read_png(m)
            payload = x.tobytes()
            found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(x)))
        return {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")} | dict(zip(names, zip(*found, strict=True), strict=True))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(picked(media, doc_id="doc_id", n_bytes="n_bytes", media="media"), rows, schema)
