"""Operator 8: PNG media columns: encode, store, read back with checksum tests, cosine-transform hash.

A payload of a multiple of 192 bytes is an 8-bit RGB picture 64 pixels wide.
``encode_png`` picks one of the row filters None, Sub and Up for a picture,
deflates the rows and frames them in chunks with their CRCs. ``decode_png``
tests signature, chunk CRCs and sizes, inflates, and undoes all five row
filters. The hash is the 8 x 8 low-frequency corner of a cosine transform of
the 32 x 32 grey picture, one bit for each coefficient above the median.

The pictures are written as a binary column of a Parquet table in the shared
folder; the features come from the bytes read back.

Defined cases: a null or empty text is one row of 64 blank pixels; equal texts
give equal pictures and hashes; ``decode_png`` raises ``ValueError`` for any
damaged picture, and ``media_features`` gives its row nulls and the reason; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, map_arrow, materialise, slices, text_of

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, CORNER = 32, 8
#: Deflate makes no more of a byte than this.
MOST_DEFLATED = 1032


def padded(data: bytes) -> bytes:
    """Blanks up to a positive multiple of a row's size."""
    return data + b" " * (-len(data) % ROW or (ROW if not data else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """A payload whose length is a positive multiple of 192 as an RGB picture."""
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of a row")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    # The sum of absolute differences, bytes taken as signed, foretells the deflated size.
    costs = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(costs))
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, (rows, sub, up)[kind]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _by_diagonals(lines: np.ndarray, above: np.ndarray, kind: int, bpp: int) -> np.ndarray:
    """Undo Average (3) or Paeth (4): a pixel needs those left, above and between, so a diagonal is one step."""
    height, width = len(lines), lines.shape[1] // bpp
    raw = lines.reshape(height, width, bpp)
    out = np.zeros((height + 1, width + 1, bpp), np.int16)
    out[0, 1:] = above.reshape(width, bpp)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, over = out[y + 1, x], out[y, x + 1]
        if kind == 3:
            guess = (left + over) >> 1
        else:
            corner = out[y, x]
            p = left + over - corner
            a, b, c = np.abs(p - left), np.abs(p - over), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, over, corner))
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters: runs of None, Sub and Up in one step each, Average and Paeth by diagonals."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    height, width = out.shape
    bounds = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        kind = int(kinds[a])
        above = out[a - 1] if a else np.zeros(width, np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack((above[None], out[a:b])), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            out[a:b] = _by_diagonals(out[a:b], above, kind, bpp)
        elif kind:
            raise ValueError(f"row filter {kind} is unknown")
    return out


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of the chunks up to the end chunk, their checksums tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IEND":
            return
        yield kind, body
        at += 12 + size
    raise ValueError("the end is missing")


def decode_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey, RGB or RGBA picture that is not interlaced, as (height, width, channels)."""
    header, parts = b"", []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            parts.append(body)
    if len(header) != 13:
        raise ValueError("no whole header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", header)
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced or not width or not height:
        raise ValueError("only plain 8-bit grey, RGB and RGBA pictures")
    packed, size = b"".join(parts), height * (width * channels + 1)
    if size > MOST_DEFLATED * len(packed) + 1024:
        raise ValueError("the rows do not fit the header")
    try:  # never more than the header says
        stream = zlib.decompressobj()
        raw = np.frombuffer(stream.decompress(packed, size + 1), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the rows cannot be inflated: {e}") from e
    if raw.size != size or not stream.eof:
        raise ValueError("the rows do not fit the header")
    return _unfilter(raw.reshape(height, -1), channels).reshape(height, width, channels)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(CORNER)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _shrink(rows: np.ndarray) -> np.ndarray:
    """(SIDE, ...) averages over equal shares of the first axis; a row across a border counts in part on both sides.

    A total up to a border is the sum of the whole rows before and a part of one row.
    """
    edges = np.linspace(0, len(rows), SIDE + 1)
    whole = np.minimum(edges.astype(np.int64), len(rows) - 1)
    starts, at = np.unique(whole, return_inverse=True)
    before = np.concatenate((np.zeros((1, *rows.shape[1:])), np.cumsum(np.add.reduceat(rows, starts, axis=0, dtype=float), axis=0)))
    before = before + rows[: starts[0]].sum(axis=0, dtype=float) if starts[0] else before
    totals = before[at] + (edges - whole)[:, None] * rows[whole]
    return np.diff(totals, axis=0) * (SIDE / len(rows))


def cosine_hash(picture: np.ndarray) -> str:
    """16 hex digits: signs of the low cosine coefficients of the grey picture against their median."""
    channels = picture.shape[2]
    small = _shrink(_shrink(picture.sum(axis=2, dtype=np.uint16)).T).T / channels
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): the texts' pictures, stored in the shared folder as a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            pictures = pa.array([encode_png(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pictures], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return materialise(map_arrow(docs.select(key, text_of(text).alias("text")), encode, f"`{key}` {kind}, n_bytes long, media binary"), "media")


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload, media, feature, damage) from stored pictures, every checksum tested; a damaged one has null payload and feature."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            rows = []
            for data in part.column(2).to_pylist():
                try:
                    picture = decode_png(data or b"")
                    rows.append((picture.tobytes(), cosine_hash(picture), None))
                except ValueError as e:
                    rows.append((None, None, str(e)))
            payloads, features, damage = (pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), payloads, part.column(2), features, damage], names=[key, "n_bytes", "payload", "media", "feature", "damage"])

    kind = media.schema[key].dataType.simpleString()
    return map_arrow(media.select(key, "n_bytes", "media"), decode, f"`{key}` {kind}, n_bytes long, payload binary, media binary, feature string, damage string")


def op8_media(spark, sf_dir: str) -> DataFrame:
    features = media_features(media_column(documents(spark, sf_dir)))
    return features.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def digest(text: str | None) -> tuple:
    """What the query must give for one text; for tests."""
    data = (text or "").encode()
    payload = padded(data)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
