"""Media columns: texts as lossless WebP images, stored in a table, read back to pixel arrays, with features.

A payload is the text's UTF-8 bytes and zeros up to a positive multiple of 64: an image 64 pixels wide, one sample a
pixel, in frames of up to 512 rows.  The stored form is the frames' files one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from ._shared import durable

WIDTH, ROWS = 64, 512


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, bytes before padding)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw)), len(raw)


def encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode(a[i : i + ROWS]) for i in range(0, len(a), ROWS))


def decode(media: bytes) -> np.ndarray:
    """Samples (rows, 64) of uint8."""
    out, at, view = [], 0, memoryview(media)
    while at < len(media):
        n = 8 + int.from_bytes(view[at + 4 : at + 8], "little")  # one frame's file is copied, not all that follow
        pixels, n = webp.decode(bytes(view[at : at + n]))
        out.append(((pixels >> 8) & 255).astype(np.uint8))
        at += n
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.uint8)


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, distinct samples and steps between neighbours in a row, of a pixel array."""
    n = samples.size
    hist = np.bincount(samples.ravel(), minlength=256)
    v = np.arange(256)
    total, square = int((hist * v).sum()), int((hist * v * v).sum())
    mean = total / n
    sd = max(0.0, square / n - mean * mean) ** 0.5
    edges = int(np.count_nonzero(samples[:, 1:] != samples[:, :-1]))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};sd={sd:.4f};distinct={int(np.count_nonzero(hist))};edges={edges}"


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media binary)``, one row per row of ``docs(doc_id, text)``.  Null is as empty: 64 zeros.
    Repeated rows are stored each; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a bounded number of images in memory
                part = b.slice(at, 256)
                texts = [payload(t) for t in part.column(1).to_pylist()]
                media = [encode(p) for p, _ in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(stored: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload binary, feature, media)`` of a table made by ``store``: the stored bytes decoded.  Null ids, repeated rows and an empty table are
    as in the stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                arrays = [decode(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array([feature(a) for a in arrays]), part.column(2)], ["doc_id", "n_bytes", "payload", "feature", "media"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, feature string, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: texts are stored as a table of images, and that table is read back."""
    back = load(durable(store(docs), "media"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(1, length(payload) - 63), 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
