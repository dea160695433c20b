"""Exact substring dedup: bytes in strings of ``SPAN`` bytes that start twice or more in the corpus.

1. Every window of SPAN bytes has an anchor, the leftmost gram of least hash in it.  Equal windows have equal
   anchors at equal offsets, so runs of windows with one anchor (regions, some 70 windows long) can only repeat
   each other within an anchor's group.  Regions alone in their group are done: nothing in them repeats.
2. Equal regions, by a 128-bit hash of all their bytes, become one region with a weight: they are counted, not moved.
3. Groups are packed in chunks, whole groups only; in each chunk the suffixes are sorted, and breadth-first backward
   extension on the Burrows-Wheeler transform derives common prefixes by increasing value and stops at SPAN: what has
   no value by then shares SPAN bytes with its neighbour.  Windows in a run of weight two or more are repeated.
4. A group of more than HOT distinct regions (a passage that very many documents quote) doesn't fit a task.  Its regions
   are cut by the anchor's offset into shorter runs of windows, STEPS long, and grouped by the bytes that all windows of
   a run have in common; equal windows stay together, different surroundings part.  What is still hot is cut finer; the
   finest runs are single windows, whose group has one distinct region.

Repeated windows give byte ranges per document, and the kept bytes their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable, release, small

SPAN = 200
GRAM = 32
HOT = 16_384
STEPS = (64, 16, 4, 1)
CHUNK = 1 << 18
#: Keys with over a SPLIT-th of the rows, at most SPLIT of them, are joined by broadcast.
SPLIT = 50_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x9E3779B97F4A7C15 | 1
    inv = pow(r, -1, 1 << 64)
    up, down = np.full(n, r, np.uint64), np.full(n, inv, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


PIECE = 1 << 18
_UP, _DOWN = _powers(2 * PIECE)


def anchors(data: np.ndarray, valid: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, count, hash, offset of the anchor from first) of the runs of windows that share an anchor.

    A window is ``span`` bytes from a position where ``valid`` holds; its anchor is the leftmost gram of least hash in it.
    Equal windows have equal anchors at equal offsets, so they are in runs of equal hash.
    """
    n = len(data)
    nothing = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n < span:
        return nothing
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
    h = (total[gram:] - total[: n - gram + 1]) * _DOWN[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    place = np.uint64((1 << 20) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    wide, reach = span - gram + 1, 1
    while reach * 2 <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    at = (low & place).astype(np.int64)
    some = np.flatnonzero(valid[: len(at)])
    if not len(some):
        return nothing
    cut = np.flatnonzero(np.r_[True, (np.diff(some) != 1) | (np.diff(at[some]) != 0)])
    first = some[cut]
    count = np.diff(np.r_[cut, len(some)])
    return first, count, h[at[first]], at[first] - first


# ---- suffixes of a chunk


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` (uint8, 0 sorts first) ordered by their first ``depth`` symbols at least."""
    n = len(t)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = t
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    order = np.argsort(key)
    key = key[order]
    small = np.int32 if n < 1 << 31 else np.int64
    order = order.astype(small)
    fresh = np.r_[True, key[1:] != key[:-1]]
    slot = np.arange(n, dtype=small)
    head = np.maximum.accumulate(np.where(fresh, slot, 0))
    rank = np.empty(n + 1, small)
    rank[order], rank[n] = head, -1
    reach = 8
    tied = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True]).astype(small)
    while reach < depth and len(tied):
        who = order[tied]
        key = rank[who].astype(np.int64) * (n + 2) + rank[np.minimum(who + reach, n)] + 1
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[tied] = who
        fresh = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[who] = head
        tied = tied[~fresh | ~np.r_[fresh[1:], True]]
        reach *= 2
    return order


def long_prefixes(t: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in ``order`` whether its suffix shares ``least`` symbols or more with the suffix before.

    Breadth-first backward extension on the Burrows-Wheeler transform: intervals of strings of length 0, 1, 2, ... are
    extended by every symbol before them; an extended interval whose end has no common-prefix value yet gets the
    present length there, and only then goes on.  Every place ends at most one interval that goes on, so all levels
    together take time in proportion to what they extend; at length ``least`` the rest is known to be longer.
    """
    n = len(t)
    small = np.int32 if n < 1 << 31 else np.int64
    bwt = t[order - 1]  # the symbol before; the first suffix takes the last symbol
    by = np.argsort(bwt, kind="stable").astype(small)
    lf = np.empty(n, small)
    lf[by] = np.arange(n, dtype=small)  # where a suffix with its symbol before it stands
    before, after = np.full(n, -1, small), np.full(n, n, small)  # the same symbol's last and next place
    same = bwt[by[1:]] == bwt[by[:-1]]
    before[by[1:][same]], after[by[:-1][same]] = by[:-1][same], by[1:][same]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0], small), np.array([n], small)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        end = np.cumsum(size)
        at = np.repeat((low - (end - size)).astype(small), size) + np.arange(int(end[-1]), dtype=small)
        first = at[before[at] < np.repeat(low, size)]
        last = at[after[at] >= np.repeat(high, size)]
        # an interval's distinct symbols, by their first and their last place in it: both in order of the extension
        new_low, new_high = np.sort(lf[first]), np.sort(lf[last]) + 1
        fresh = open_[new_high]
        open_[new_high[fresh]] = False
        low, high = new_low[fresh], new_high[fresh]
    return open_[:n]


def repeated_windows(regions: list[bytes], weights: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each region, whether each of its windows of ``span`` bytes occurs twice or more among all regions, a region
    counting ``weights`` times."""
    t = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    sizes = np.array([len(r) for r in regions])
    start = np.cumsum(sizes + 1) - sizes - 1
    live = np.zeros(len(t), np.int64)  # weight of the window that starts here
    windows = sizes - span + 1
    which = np.repeat(np.arange(len(regions)), windows)
    places = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    live[places] = weights[which]
    coded = t.astype(np.uint16) + 1
    coded[start + sizes] = 0
    if coded.max() > 255:  # UTF-8 has no such bytes; other input gets dense codes
        coded = np.unique(coded, return_inverse=True)[1].astype(np.uint16)
        if coded.max() > 255:
            raise ValueError("a chunk has all 256 byte values")
    coded = coded.astype(np.uint8)
    order = suffix_order(coded, span)
    run = np.cumsum(~long_prefixes(coded, order, span))
    mass = np.bincount(run, weights=live[order])
    hit = np.zeros(len(t), bool)
    hit[order] = mass[run] >= 2
    return np.split(hit[places], np.cumsum(windows)[:-1])


# ---- on Spark


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, k, a, n, o, h, r, q) of the regions of each text: windows a to a + n - 1, the anchor's hash h and its
    offset o from a, and r, q, a hash of the region's bytes."""
    for b in batches:
        ids, keys, texts = b.column(0), b.column(1), b.column(2)
        held: list[tuple[int, int, bytes]] = []  # (row, offset in its text, bytes): pieces of at most PIECE windows
        size = 0
        for i, t in enumerate(texts):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(0, len(raw) - SPAN + 1), PIECE):
                piece = raw[at : at + PIECE + SPAN - 1]
                if held and size + len(piece) > PIECE:
                    yield _found(held, ids, keys)
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            yield _found(held, ids, keys)


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) int64: 128-bit hashes of slices."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)


def _found(held: list[tuple[int, int, bytes]], ids: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    sizes = np.array([len(p) for _, _, p in held])
    end = np.cumsum(sizes)
    joined = b"".join(p for _, _, p in held)
    data = np.frombuffer(joined, np.uint8)
    valid = np.ones(len(data), bool)
    for e in end.tolist():
        valid[max(0, e - SPAN + 1) : e] = False
    first, count, h, offset = anchors(data, valid)
    which = np.searchsorted(end, first, side="right")
    a = first - (end - sizes)[which] + np.array([o for _, o, _ in held])[which]
    row = pa.array(np.array([i for i, _, _ in held])[which])
    rq = _digests(joined, first, first + count + SPAN - 1)
    return pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(a, pa.int64()), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(rq[:, 0]), pa.array(rq[:, 1])], ["d", "k", "a", "n", "o", "h", "r", "q"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, k, text, cuts array of (a, n, o, h, c)) to one row a region with its bytes."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            out: dict[str, list] = {x: [] for x in ("d", "k", "a", "n", "o", "h", "c", "data")}
            for d, k, t, cuts in zip(*(part.column(i).to_pylist() for i in range(4))):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for x in cuts:
                    for name, v in (("d", d), ("k", k), ("a", x["a"]), ("n", x["n"]), ("o", x["o"]), ("h", x["h"]), ("c", x["c"]), ("data", raw[x["a"] : x["a"] + x["n"] + SPAN - 1])):
                        out[name].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _ranges(hit: np.ndarray, a: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(a + int(s), a + int(e) - 1 + SPAN) for s, e in zip(edge[::2], edge[1::2])]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h: whole groups in chunks of about CHUNK bytes; ranges of the repeated windows of each region, where
    its weight is 1: of heavier regions all windows are repeated."""

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "data"])
        hits = repeated_windows(rows.data.tolist(), rows.c.to_numpy())
        found = [(d, k, *x) for d, k, a, c, hit in zip(rows.d.tolist(), rows.k.tolist(), rows.a.tolist(), rows.c, hits) if c == 1 and hit.any() for x in _ranges(hit, a)]
        return pd.DataFrame(found, columns=["d", "k", "s", "e"]).astype("int64")

    rest: list[pd.DataFrame] = []
    size = 0
    for b in (x[i : i + 512] for x in batches for i in range(0, len(x), 512)):
        rest.append(b)
        size += int(b.data.map(len).sum())
        if size < CHUNK:
            continue
        rows = pd.concat(rest, ignore_index=True)
        open_ = rows.h == rows.h.iat[-1]  # sorted by h: only the last group may go on
        if not open_.all():
            yield chunk(rows[~open_])
        rest = [rows[open_]]
        size = int(rest[0].data.map(len).sum())
    if rest and sum(map(len, rest)):
        yield chunk(pd.concat(rest, ignore_index=True))


def _finer(step: int):
    """mapInPandas function: regions of hot groups cut into runs of windows whose anchor offsets share offset // step; the
    new group is told by the old, the offsets and the bytes in all windows of the run's offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for h, d, k, a, n, o, c, data in b.iloc[at : at + 256][["h", "d", "k", "a", "n", "o", "c", "data"]].itertuples(index=False):
                    i = 0
                    while i < n:  # window i has the anchor at offset o - i
                        cell = (o - i) // step
                        j = min(n, o - cell * step + 1)
                        core = data[o - cell * step : o - (cell * step + step - 1) + SPAN] if step > 1 else data[i : i + SPAN]
                        own = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little", signed=True) + cell.to_bytes(4, "little") + core)
                        part = data[i : j + SPAN - 1]
                        r = xxhash.xxh3_128_digest(part)
                        rows.append((own - (1 << 63), d, k, a + i, j - i, o - i, c, part, int.from_bytes(r[:8], "little", signed=True), int.from_bytes(r[8:], "little", signed=True)))
                        i = j
                yield pd.DataFrame(rows, columns=["h", "d", "k", "a", "n", "o", "c", "data", "r", "q"])

    return run


def _joined(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """Left semi join of ``rows`` with ``keyed(*on, rows)``, distinct keys and how often ``rows`` has them.  Keys of over
    total / SPLIT rows, at most SPLIT, are broadcast, so their rows stay where they are; the others are shuffled."""
    bound = max(1000, total // SPLIT)
    heavy = durable(keyed.where(F.col("rows") > bound).select(*on), "heavy")
    if heavy.isEmpty():
        return rows.join(keyed, on, "left_semi")
    light = rows.join(F.broadcast(heavy), on, "left_anti").join(keyed.where(F.col("rows") <= bound), on, "left_semi")
    return light.unionByName(rows.join(F.broadcast(heavy), on, "left_semi"))


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(d, k, s, e)``: byte ranges (end exclusive) of ``docs(doc_id, text)`` in which every string of SPAN bytes
    occurs elsewhere; d is the doc_id (null: -1) and k a hash of the text.  Ranges may overlap or repeat."""
    base = docs.select(*_key(), "text")
    all_ = durable(base.mapInArrow(_regions, "d long, k long, a long, n int, o int, h long, r long, q long"), "regions")
    total = all_.count()
    again = durable(all_.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    shared = durable(_joined(all_, again, ["h"], total), "shared")
    release(all_, again)
    region = ["h", "n", "r", "q"]
    kinds = durable(shared.groupBy(*region).agg(F.count("*").alias("c"), F.min(F.struct("d", "k", "a", "o")).alias("at")), "kinds")
    whole = _joined(shared, kinds.where("c > 1").select(*region, F.col("c").alias("rows")), region, total)
    out = whole.select("d", "k", F.col("a").alias("s"), (F.col("a") + F.col("n") + (SPAN - 1)).alias("e"))
    pool = kinds.select("at.d", "at.k", "at.a", "n", "at.o", "h", "c")
    cuts = pool.groupBy("d", "k").agg(F.collect_list(F.struct("a", "n", "o", "h", "c")).alias("cuts"))
    data = base.join(cuts, ["d", "k"]).select("d", "k", "text", "cuts").mapInArrow(_bytes, "d long, k long, a long, n int, o int, h long, c long, data binary")
    schema = "d long, k long, s long, e long"
    solved = lambda rows: rows.repartition("h").sortWithinPartitions("h").select("h", "d", "k", "a", "c", "data").mapInPandas(_solve, schema)
    many = durable(kinds.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("h"), "hot")  # few: each has over ``hot`` regions
    for step in STEPS:
        if many.isEmpty():
            return out.unionByName(solved(data))
        data = durable(data, "pool")
        out = out.unionByName(solved(data.join(small(many), "h", "left_anti")))
        fine = data.join(small(many), "h", "left_semi").dropDuplicates(["h", "data"]).mapInPandas(_finer(step), "h long, d long, k long, a long, n int, o int, c long, data binary, r long, q long")
        fine = durable(fine, "fine")
        # runs that have become equal are one again; those of weight 1 in ``fine`` have their ranges to give
        merged = fine.groupBy(*region).agg(F.sum("c").alias("w"), F.count("*").alias("rows"), F.min(F.struct("d", "k", "a", "o", "c", "data")).alias("at"))
        merged = durable(merged.select(*region, "w", "rows", "at.*"), "merged")
        twice = _joined(fine, merged.where("w > 1").select(*region, "rows"), region, fine.count())
        out = out.unionByName(twice.where("c = 1").select("d", "k", F.col("a").alias("s"), (F.col("a") + F.col("n") + (SPAN - 1)).alias("e")))
        data = merged.select("d", "k", "a", "n", "o", "h", F.col("w").alias("c"), "data")
        many = durable(merged.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("h"), "hot")
    # single windows: a group is one window, unless 64-bit group hashes meet; its weight says all
    return out


def _key() -> list[Column]:
    """A row's key: its id, -1 for null, and a hash of its text; rows of one key have one text and one result."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")]


def _cut(raw: bytes, ranges: list[tuple[int, int]] | None) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    removed, runs, kept, at = 0, 0, [], 0
    end = -1
    for s, e in sorted(ranges or []):
        if s > end:
            kept.append(raw[at:s])
            runs += 1
            removed += e - s
        elif e > end:
            removed += e - end
        end = max(end, e)
        at = end
    kept.append(raw[at:])
    return removed, runs, b"".join(kept)


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary)``, one row per row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes; null is empty.  Removed is each byte covered by a string of SPAN bytes that also starts
    anywhere else, the same document included; strings are judged on the input.  Rows that repeat a text of SPAN
    bytes or more lose all of it, all of them.  Texts shorter than SPAN lose nothing.  An empty table gives no rows;
    other columns are ignored.  ``kept`` need not be UTF-8, as a cut may fall inside a character.
    """
    ranges = repeated_ranges(docs, hot).groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    ranges = durable(ranges, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                done = [_cut(raw, [(x["s"], x["e"]) for x in r or []]) for raw, r in zip(raws, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(r) for r in raws], pa.int64()), *(pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done]), pa.array([d[2] for d in done], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    joined = docs.select(F.col("doc_id").cast("long"), "text", *_key()).join(ranges, ["d", "k"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
