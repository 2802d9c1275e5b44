"""PNG files as rows of pixels, and back: eight bits a channel, without interlacing. An image is one row's work, and one of too many pixels is never decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The signature, and the number of channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels that travel in one piece.
PIECE = 512


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(gray: np.ndarray) -> bytes:
    """A gray image, rows unfiltered."""
    height, width = gray.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray.astype(np.uint8)], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(line: np.ndarray, above: np.ndarray, kind: int, step: int) -> np.ndarray:
    """A row of bytes from its differences; the predictions are those of the file format."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # sums along each channel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], dtype=np.uint8)


def decode(content: bytes, most: int = 50_000_000) -> np.ndarray | None:
    """Height x width x (red, green, blue, alpha), or None if this isn't such a file, is broken or has more than ``most`` pixels."""
    if not content or not content.startswith(SIGNATURE):
        return None
    at, data, palette, clear, head = len(SIGNATURE), [], None, b"", None
    try:
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
                if head[0] * head[1] > most or head[2] != 8 or head[6] or head[3] not in CHANNELS:
                    return None
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                clear = body
            elif kind == b"IDAT":
                data.append(body)
        width, height, _, colour = head[:4]
        step = CHANNELS[colour]
        rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
        out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
        for y in range(height):
            above = out[y] = _unfiltered(rows[y, 1:], above, int(rows[y, 0]), step)
    except (struct.error, zlib.error, ValueError, TypeError, IndexError):
        return None
    pixels = out.reshape(height, width, step)
    alpha = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        table = np.concatenate([np.frombuffer(clear, np.uint8), np.full(256 - len(clear), 255, np.uint8)])
        return np.concatenate([palette[pixels[..., 0]], table[pixels[..., 0]][..., None]], axis=2)
    if colour in (0, 4):
        return np.concatenate([np.repeat(pixels[..., :1], 3, axis=2), pixels[..., 1:] if colour == 4 else alpha], axis=2)
    return pixels if colour == 6 else np.concatenate([pixels, alpha], axis=2)


def pixels(files: DataFrame, page: str = "path", most: int = 50_000_000) -> DataFrame:
    """(page, y, x, r, g, b, a) of files (page, content); files that can't be read have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column("page"), batch.column("content")):
                image = decode(content.as_py(), most)
                if image is None:
                    continue
                for top in range(0, len(image), 64):
                    part = image[top : top + 64]
                    y, x = np.indices(part.shape[:2])
                    columns = [pa.repeat(key, y.size), pa.array((y.ravel() + top).astype(np.int32)), pa.array(x.ravel().astype(np.int32))]
                    columns += [pa.array(part[..., k].ravel().astype(np.int32)) for k in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, names=["page", "y", "x", "r", "g", "b", "a"])

    kind = files.schema[page].dataType.simpleString()
    return files.select(F.col(page).alias("page"), "content").mapInArrow(run, f"page {kind}, y int, x int, r int, g int, b int, a int")


def images(gray: DataFrame) -> DataFrame:
    """(page, content): the PNG file of each page of (page, y, x, v); places without a pixel are white. Pixels are packed where they are and
    travel by page; a task holds one image at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = batch.column("page").dictionary_encode()
                code = known.indices.to_numpy()
                data = np.stack([batch.column(c).to_numpy() for c in ("y", "x", "v")])
                if (code[1:] < code[:-1]).any():
                    order = np.argsort(code, kind="stable")
                    code, data = code[order], data[:, order]
                ends = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
                cut = [(i, min(i + PIECE, e)) for s, e in zip(ends, ends[1:]) for i in range(s, e, PIECE)]
                yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(code[[i for i, _ in cut]])), pa.array([data[:, i:e].tobytes() for i, e in cut], pa.binary())], names=["page", "data"])

    def drawn(key: pa.Scalar, parts: list[np.ndarray]) -> pa.RecordBatch:
        y, x, v = np.concatenate(parts, axis=1)
        order = np.argsort(v, kind="stable")  # of several pixels at one place the lightest shows
        image = np.full((y.max() + 1, x.max() + 1), 255, np.uint8)
        image[y[order], x[order]] = v[order]
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([encode(image)], pa.binary())], names=["page", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for key, data in zip(batch.column("page"), batch.column("data")):
                if parts and key != now:
                    yield drawn(now, parts)
                    parts = []
                now = key
                parts.append(np.frombuffer(data.as_buffer(), np.int32).reshape(3, -1))
        if parts:
            yield drawn(now, parts)

    kind = gray.schema["page"].dataType.simpleString()
    whole = gray.select("page", *[F.col(c).cast("int").alias(c) for c in ("y", "x", "v")]).dropna()
    pieces = whole.mapInArrow(pack, f"page {kind}, data binary").repartition("page").sortWithinPartitions("page")
    return pieces.mapInArrow(run, f"page {kind}, content binary")
