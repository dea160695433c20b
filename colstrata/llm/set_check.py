"""Shingle sets: their hashes, their fingerprints, and the exact similarity of pairs among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small

#: Odd multipliers that place a word in its shingle and a lane in its fingerprint.
PLACE, LANE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct shingles of ``words`` words, ascending: the words' XXH64, combined by place.

    Letters A-Z count as a-z; words end at ASCII white space; a text of fewer words is one shingle; null, empty or
    blank texts have none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(PLACE) + w[j : j + n]
    return np.unique(_stirred(h))


def fingerprint(found: np.ndarray, width: int) -> bytes:
    """SimHash of a set: a bit is 1 if it is set in over half of the hashes; lanes of 64 bits, each by its own mixing."""
    out, n = b"", len(found)
    for lane in range(width // 64):
        h = _stirred(found + np.uint64(LANE * (lane + 1) & 0xFFFFFFFFFFFFFFFF)).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            ones += np.unpackbits(h[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(ones * 2 > n).tobytes()
    return out


def sketches(docs: DataFrame, words: int, width: int) -> DataFrame:
    """``(doc_id, s1 long, s2 long, n int, fp binary)`` of ``docs(doc_id, text)``: a 128-bit hash of the set, its size and
    its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f.tobytes()) for f in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(f) for f in sets], pa.int32()), pa.array([fingerprint(f, width) for f in sets], pa.binary())],
                ["doc_id", "s1", "s2", "n", "fp"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, s1 long, s2 long, n int, fp binary")


def linked(sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets whose cosine, shared over the root of the sizes' product, is ``similarity`` = p / q or more.

    What any two share is counted for all pairs at once, by products of 0-1 matrices over the hashes that several sets have.
    """
    p, q = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times > 1
    place = np.cumsum(many) - 1
    keep = many[column]
    row, column = row[keep], place[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact below 2 ** 24
    step = max(1, (1 << 24) // max(1, len(sets)))
    for at in range(0, int(many.sum()), step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), min(step, int(many.sum()) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    both = shared.astype(np.int64) * q
    i, j = np.nonzero(np.triu(both * both >= p * p * sizes[:, None] * sizes[None, :], 1))
    return i, j


def hashed(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, hashes binary)``: the sets of the documents whose doc_id is among ``nodes(node)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(small(nodes.select("node")), "node", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(sets, "node long, hashes binary")
