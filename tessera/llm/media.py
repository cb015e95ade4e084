"""Media columns: Netpbm and BMP bytes, integral-image resizing, NPY tiles and difference hashes.

A document's bytes, blank-padded to a positive multiple of 192, are stored as a binary PPM of
8 by 8k RGB samples (192 bytes are 8 rows of 8 pixels), read back, and reduced by area averages
of integral images to a 9 by 8 grey tile, whose left-to-right differences are the 64-bit hash.

Defined results: null and empty texts are one block of blanks; equal texts give equal values;
a malformed image raises ValueError in decode(), and gives null features in media_features().
"""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

BLOCK = 192
#: Rows of samples whose integral image is in memory at once.
BAND = 4096


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """payload with blanks up to a positive multiple of block."""
    return payload.ljust(max(block, -(-len(payload) // block) * block), b" ")


def write_netpbm(a: np.ndarray) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3); 8-bit samples."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def write_bmp(a: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP, bottom row first, rows padded to four bytes."""
    h, w = a.shape[:2]
    rgb = a if a.ndim == 3 else np.repeat(a[:, :, None], 3, 2)
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    head = b"BM" + (54 + rows.size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\1\0\x18\0" + bytes(4) + rows.size.to_bytes(4, "little") + bytes(16)
    return head + info + rows.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """count numbers of a Netpbm header and where the samples begin; comments are skipped."""
    at, out = 2, []
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM (plain and raw, 8 bits) and uncompressed 8-, 24- and 32-bit BMP as uint8 arrays; ValueError for anything else."""
    try:
        a = _decoded(bytes(data))
    except (IndexError, OverflowError, MemoryError) as e:  # samples beyond a palette or 8 bits, sizes beyond all bytes
        raise ValueError(str(e)) from e
    if not a.size:
        raise ValueError("an image without samples")
    return a


def _decoded(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise ValueError("neither Netpbm nor BMP")
    kind = data[1] - 48
    bits, plain, planes = kind in (1, 4), kind < 4, 3 if kind in (3, 6) else 1
    (w, h, *most), at = _header(data, 2 if bits else 3)
    if most and not 0 < most[0] < 256:
        raise ValueError("only 8-bit samples")
    n = w * h * planes
    if bits:
        if plain:
            a = 1 - np.array([b - 48 for b in data[at:] if b in b"01"][:n], np.uint8)
        else:
            line = -(-w // 8)
            a = 1 - np.unpackbits(np.frombuffer(data, np.uint8, line * h, at).reshape(h, line), axis=1)[:, :w].ravel()
        a = a * np.uint8(255)
    else:
        a = _plain(data[at:].split()[:n], most[0]) if plain else np.frombuffer(data, np.uint8, n, at) if len(data) >= at + n else np.empty(0, np.uint8)
        if most[0] != 255:
            a = (a.astype(np.uint16) * 255 // most[0]).astype(np.uint8)
    if len(a) < n:
        raise ValueError("samples are missing")
    return a.reshape((h, w, 3) if planes == 3 else (h, w))


def _plain(found: list[bytes], most: int) -> np.ndarray:
    """Samples written as decimal numbers."""
    a = np.array([int(x) for x in found], np.int64)
    if len(a) and not 0 <= a.min() <= a.max() <= most:
        raise ValueError("a sample is out of range")
    return a.astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken BMP header")
    word = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, w, h, bits = word(10), word(18, signed=True), word(22, signed=True), word(28, 2)
    if word(30) or bits not in (8, 24, 32) or w <= 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    line, rows = -(-w * bits // 32) * 4, abs(h)
    if len(data) < start + line * rows:
        raise ValueError("samples are missing")
    a = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)[:, : w * bits // 8]
    a = a[::-1] if h > 0 else a
    if bits == 8:
        size = start - 14 - word(14)
        if size < 4 or size % 4:
            raise ValueError("broken palette")
        table = np.frombuffer(data, np.uint8, size, 14 + word(14)).reshape(-1, 4)[:, 2::-1]
        return np.ascontiguousarray(table[a])
    return np.ascontiguousarray(a.reshape(rows, w, bits // 8)[:, :, 2::-1])


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else ((a[..., 0].astype(np.uint32) * 299 + a[..., 1].astype(np.uint32) * 587 + a[..., 2].astype(np.uint32) * 114) // 1000).astype(np.uint8)


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over an h by w grid of areas, from integral images; fractional borders count in part."""
    rows, cols = a.shape
    ys, xs = np.linspace(0, rows, h + 1), np.linspace(0, cols, w + 1)
    x0 = np.minimum(xs.astype(np.int64), cols)
    part = xs - x0
    grid = np.zeros((h + 1, w + 1))
    base, at = np.zeros(cols + 1), 0
    for top in range(0, rows, BAND):
        band = np.zeros((min(BAND, rows - top) + 1, cols + 1))
        band[1:, 1:] = a[top : top + BAND].cumsum(0, np.float64).cumsum(1)
        band += base
        while at <= h and (ys[at] < top + len(band) - 1 or top + len(band) - 1 == rows):
            y = min(int(ys[at]), rows) - top
            line = band[y] + (ys[at] - int(ys[at])) * (band[min(y + 1, len(band) - 1)] - band[y])
            grid[at] = line[x0] + part * (line[np.minimum(x0 + 1, cols)] - line[x0])
            at += 1
        base = band[-1].copy()
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return np.clip(np.rint(sums / (rows / h * cols / w)), 0, 255).astype(np.uint8)


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def features(a: np.ndarray) -> tuple[bytes, str]:
    """The 8 by 9 tile as NPY bytes and its difference hash."""
    tile = area_resize(grey(a), 8, 9)
    return npy(tile), np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def text_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per document with the digests of payload and stored form, and the features."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile_sha256 string" + ", media binary, tile binary" * keep_bytes
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "media", "tile"]

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in rows_of([batch], "k", "t"):
                raw = (text or "").encode()
                media = write_netpbm(np.frombuffer(pad(raw), np.uint8).reshape(-1, 8, 3))
                back = decode(media)
                tile, mark = features(back)
                payload = back.tobytes()
                rows.append((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), mark, hashlib.sha256(tile).hexdigest(), *((media, tile) if keep_bytes else ())))
            kinds = [batch.schema.field("k").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()][: 11 if keep_bytes else 9]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names[: len(kinds)])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def media_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Height, width, NPY tile and difference hash of a column of images; nulls where it can't be decoded."""
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in rows_of([batch], "k", "m"):
                try:
                    a = decode(data or b"")
                    rows.append((key, a.shape[0], a.shape[1], *features(a)))
                except ValueError:
                    rows.append((key, None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field("k").type, pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=[id_col, "height", "width", "tile", "dhash"])

    return df.select(F.col(id_col).alias("k"), F.col(media_col).alias("m")).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, tile binary, dhash string")
