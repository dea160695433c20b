"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are compared in tiles of numpy arrays by exclusive-or and bit counts.  Rows are ordered by population
count, and a pair of tiles is skipped when its population counts differ by more than the radius (two fingerprints at
distance d differ by at most d in their counts), so nothing is lost.

``near_duplicates`` links fingerprints at a small radius.  The fingerprint is cut in radius + 1 blocks: two within the
radius agree on a whole block, so only fingerprints that share a block (a bucket) meet, in tiles, whatever the size of
the bucket; buckets over ``tile`` rows are spread over the cluster by tile pairs.  A radius too wide for blocks makes
all fingerprints one bucket.  Only a spanning forest of each tile pair's links leaves the task, never all pairs of a
group; equal fingerprints are merged before.  Components then come from star contraction on Spark.

``near_dedup`` is for shingle sets: the same tiles, at a wide radius, find which sets may be alike, and among these every
link is found on the whole sets, so none is false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded, components, durable, quoted, small, without
from .set_check import hashed, linked, sketches

TILE = 16_384
#: Rows of a tile inside a bucket that one task holds whole.
INNER = 256
#: Cosine of shingle sets, as p / q, and the fingerprints that find it: at 4/5 two sets differ in 0.2048 of the bits, 52.4 of
#: 256 with a deviation of 6.5; the radius is 2.5 deviations above.
SIMILARITY, WIDTH, RADIUS = (4, 5), 256, 68
#: Sets of a candidate group that one task compares on their whole hashes.
ROOM = 1024


def fingerprint(text: str | None, words: int = 3, width: int = 64, seed: int = 42) -> bytes:
    """``width`` bits (a multiple of 64), big-endian.  A bit is 1 if it is set in over half of the shingles' XXH64.

    Letters A-Z count as a-z; words end at ASCII white space; a text of fewer words is one shingle; null, empty or
    blank texts give zeros.  Bits 64 on use seed + 1, and so on.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return bytes(width // 8)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(tokens))
    s, e = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    out = b""
    for lane in range(width // 64):
        h = xxhash.xxh64_intdigest
        sd = seed + lane
        hashes = np.array([h(joined[i:j], sd) for i, j in zip(s, e)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        n, ones = len(hashes), np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(ones * 2 > n).tobytes()
    return out


def fingerprints(docs: DataFrame, words: int = 3, width: int = 64, seed: int = 42) -> DataFrame:
    """``(doc_id, fp binary)`` for every row of ``docs`` (columns doc_id, text; others are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words, width, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary")


def _links(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) of rows at distance <= radius, and the distances; x, y: (n, lanes) uint64.

    Lanes are added up over all pairs until unrelated rows are far beyond the radius, the others for what is left.
    """
    lanes = x.shape[1]
    full = next((m for m in range(1, lanes + 1) if 32 * m - 12 * m**0.5 >= radius), lanes)
    kind = np.uint8 if full < 4 else np.uint16
    columns = [np.ascontiguousarray(y[:, k]) for k in range(lanes)]
    step = max(1, 131_072 // max(1, len(y)))
    for at in range(0, len(x), step):
        d = np.bitwise_count(x[at : at + step, 0, None] ^ columns[0]).astype(kind, copy=False)
        for k in range(1, full):
            d += np.bitwise_count(x[at : at + step, k, None] ^ columns[k])
        i, j = np.nonzero(d <= radius)
        if not len(i):
            continue
        total = d[i, j].astype(np.int64)
        for k in range(full, lanes):
            total += np.bitwise_count(x[at + i, k] ^ y[j, k])
        near = total <= radius
        if near.any():
            yield i[near] + at, j[near], total[near]


class _Forest:
    """Union-find over positions; ``join`` takes arrays and keeps the smaller root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _star(nodes: np.ndarray, forest: _Forest) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its tree (nodes ascending is not assumed)."""
    root = forest.roots(np.arange(len(nodes)))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root, nodes)
    to = low[root]
    keep = to != nodes
    return nodes[keep], to[keep]


def _unpack(blob: bytes, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(blob, dtype=">u8").reshape(-1, lanes + 1)
    return a[:, 1:].astype(np.uint64), a[:, 0].astype(np.uint64).view(np.int64)


def _runs(radius: int, lanes: int):
    """mapInPandas function over rows sorted by key: links inside each run of one key (runs of at most TILE rows)."""

    def solve(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
        counts = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
        by = np.lexsort((counts, keys))
        keys, fps, nodes, counts = keys[by], fps[by], nodes[by], counts[by]
        forest = _Forest(len(keys))
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        # buckets of one tile: all of them at once, by distance in the order of counts, until the counts differ too much
        live, offset = np.flatnonzero(np.repeat(size <= 64, size)), 1
        while len(live):
            live = live[live + offset < len(keys)]
            live = live[(keys[live] == keys[live + offset]) & (counts[live + offset] - counts[live] <= radius)]
            if len(live):
                d = np.bitwise_count(fps[live] ^ fps[live + offset]).sum(axis=1, dtype=np.int64)
                near = live[d <= radius]
                forest.join(near, near + offset)
            offset += 1
        for s, n in zip(cut[size > 64], size[size > 64]):
            for a in range(s, s + n, INNER):
                b = min(a + INNER, s + n)
                last = s + int(np.searchsorted(counts[s : s + n], counts[b - 1] + radius, side="right"))
                for c in range(a, last, INNER):  # tiles whose counts come within the radius
                    for i, j, _ in _links(fps[a:b], fps[c : min(c + INNER, last)], radius):
                        forest.join(i + a, j + c)
        a, b = _star(nodes, forest)
        return pd.DataFrame({"a": a, "b": b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held = 0
        for b in batches:
            rest.append(b)
            held += len(b)
            if held < 4 * TILE:
                continue
            all_ = pd.concat(rest, ignore_index=True)
            last = all_.key.iat[-1]
            done = int((all_.key.to_numpy() != last).sum())  # sorted: what precedes the last key's run is whole
            yield solve(all_.key.to_numpy()[:done], _cells(all_.fp[:done], lanes), all_.node.to_numpy()[:done])
            rest, held = [all_[done:]], len(all_) - done
        if rest:
            all_ = pd.concat(rest, ignore_index=True)
            yield solve(all_.key.to_numpy(), _cells(all_.fp, lanes), all_.node.to_numpy())

    return run


def _cells(fps: pd.Series, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, lanes)


def _tile_pairs(radius: int, lanes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left, right, same in zip(b.blob, b.blob2, b.same):
                x, p = _unpack(left, lanes)
                y, q = (x, p) if same else _unpack(right, lanes)
                nodes = p if same else np.concatenate([p, q])
                forest = _Forest(len(nodes))
                for i, j, _ in _links(x, y, radius):
                    forest.join(i, j if same else j + len(p))
                a, c = _star(nodes, forest)
                yield pd.DataFrame({"a": a, "b": c})

    return run


def links(fps: DataFrame, radius: int, width: int = 64, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` spanning all links of ``fps(fp binary, node long)``; fp distinct; a node of several fps is one node.

    Two fingerprints link at ``radius`` or fewer differing bits.  An empty table gives no edges.
    """
    lanes = width // 64
    blocks = radius + 1 if width // (radius + 1) >= 16 else 0
    ones = sum((F.bit_count(F.conv(F.substring(F.hex("fp"), 8 * k + 1, 8), 16, 10).cast("long")) for k in range(width // 32)), F.lit(0))
    base = fps.withColumn("pc", ones.cast("int"))
    if blocks:
        bits = F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("long")  # lane 0 carries the blocks
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        keys = [F.shiftleft(F.lit(k).cast("long"), 58).bitwiseOR(F.shiftrightunsigned(F.shiftleft(bits, cuts[k]), 64 - (cuts[k + 1] - cuts[k]))) for k in range(blocks)]
        if width != 64:
            raise ValueError("blocks are cut from 64-bit fingerprints")
        base = base.withColumn("key", F.explode(F.array(*keys)))
    else:
        base = base.withColumn("key", F.lit(0).cast("long"))
    load = base.groupBy("key", "pc").count()
    per_key = load.groupBy("key").agg(F.sum("count").alias("n"), F.sort_array(F.collect_list(F.struct("pc", F.ceil(F.col("count") / tile).cast("int").alias("cuts")))).alias("classes"))
    per_key = durable(per_key.where("n > 1"), "buckets")
    cold = base.join(per_key.where(F.col("n") <= tile).select("key"), "key", "left_semi")
    cold = cold.select("key", "pc", "fp", "node").repartition("key").sortWithinPartitions("key", "pc")
    out = cold.mapInPandas(_runs(radius, lanes), "a long, b long")
    hot = per_key.where(F.col("n") > tile)
    if not hot.isEmpty():
        rows = base.join(hot.select("key", "classes"), "key")
        cuts = F.element_at(F.filter("classes", lambda c: c["pc"] == F.col("pc")), 1)["cuts"]
        cell = F.concat(F.unhex(F.lpad(F.hex("node"), 16, "0")), "fp")
        tiles = rows.select("key", "pc", F.pmod(F.xxhash64("fp"), cuts).alias("cut"), cell.alias("cell"))
        tiles = tiles.groupBy("key", "pc", "cut").agg(F.collect_list("cell").alias("cells"))
        tiles = durable(tiles.select("key", "pc", "cut", F.unhex(F.array_join(F.transform("cells", F.hex), "")).alias("blob")), "tiles")
        near = F.flatten(F.transform(F.filter("classes", lambda c: (c["pc"] >= F.col("pc")) & (c["pc"] <= F.col("pc") + radius)), lambda c: F.transform(F.sequence(F.lit(0), c["cuts"] - 1), lambda s: F.struct(c["pc"].alias("pc2"), s.cast("long").alias("cut2")))))
        pairs = tiles.select("key", "pc", "cut").join(F.broadcast(hot.select("key", "classes")) if hot.count() <= 1000 else hot.select("key", "classes"), "key")
        pairs = pairs.select("key", "pc", "cut", F.explode(near).alias("t")).select("key", "pc", "cut", "t.pc2", "t.cut2").where("pc2 > pc OR cut2 >= cut")
        right = tiles.select("key", F.col("pc").alias("pc2"), F.col("cut").alias("cut2"), F.col("blob").alias("blob2"))
        joined = pairs.join(tiles, ["key", "pc", "cut"]).join(right, ["key", "pc2", "cut2"])
        n = max(1, min(4096, joined.sparkSession.sparkContext.defaultParallelism * 4))
        joined = joined.select("blob", "blob2", F.expr("pc = pc2 AND cut = cut2").alias("same"), F.xxhash64("key", "pc", "cut", "pc2", "cut2").alias("at")).repartition(n, "at")
        out = out.unionByName(joined.drop("at").mapInPandas(_tile_pairs(radius, lanes), "a long, b long"))
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, width: int = 64, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp binary, component_id)``, one row per row of ``docs``.

    component_id: the smallest doc_id reachable over links.  Null and empty texts have fingerprint zero and link
    like any other.  A null doc_id keeps its row; its component is the smallest other doc_id with an equal
    fingerprint or linked to it, or null where there is none.  Repeated rows come out as often as they came in.
    """
    docs_fp = durable(fingerprints(docs, words, width), "fp")
    nodes = durable(docs_fp.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    label = components(links(nodes, radius, width, tile).unionByName(_several(docs_fp, nodes, ["fp"])))
    of = nodes.join(label, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return docs_fp.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def _several(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges ``(a, b)`` from each doc_id that has several ``keys`` to the nodes of these."""
    key = F.struct(*keys)
    many = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(key) != F.max(key)).alias("many")).where("many").select("doc_id")
    own = rows.join(durable(many, "several"), "doc_id", "left_semi").select("doc_id", *keys).distinct()
    return own.join(nodes, keys).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


# ---- shingle sets


def _candidates(radius: int, lanes: int, ratio: float):
    """mapInPandas function over tile pairs: edges ``(a, b)`` that span the pairs within the radius.  Sizes further apart
    than ``ratio`` are not compared: the rows of a tile are in order of size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left, right, same in zip(b.blob, b.blob2, b.same):
                x = _cut(left, lanes)
                y = x if same else _cut(right, lanes)
                nodes, shift = (x[0], 0) if same else (np.concatenate([x[0], y[0]]), len(x[0]))
                forest = _Forest(len(nodes))
                for i, j in close(x, y):
                    forest.join(i, j + shift)
                a, c = _star(nodes, forest)
                yield pd.DataFrame({"a": a, "b": c})

    def close(x, y):
        for at in range(0, len(x[1]), INNER):
            n = x[1][at : at + INNER]
            lo, hi = np.searchsorted(y[1], [n[0] * ratio - 1e-6, n[-1] / ratio + 1e-6])
            if lo < hi:
                for i, j, _ in _links(x[2][at : at + INNER], y[2][lo:hi], radius):
                    m, k = n[i], y[1][j + lo]
                    fits = np.minimum(m, k) >= np.maximum(m, k) * ratio - 1e-6
                    yield i[fits] + at, j[fits] + lo

    return run


def _cut(blob: bytes, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, fingerprints) of a tile, by size."""
    a = np.frombuffer(blob, dtype=">u8").astype(np.uint64).reshape(-1, lanes + 2)
    a = a[np.argsort(a[:, 1], kind="stable")]
    return a[:, 0].view(np.int64), a[:, 1].astype(np.float64), np.ascontiguousarray(a[:, 2:])


def _tile_joins(rows: DataFrame, radius: int, ratio: float, tile: int) -> DataFrame:
    """``(blob, blob2, same)``: the tile pairs of ``rows(node, n, fp, pc)`` that may hold candidates.

    Rows are dealt to size classes, and in a class to tiles by population count.  Tiles of the same or neighbouring
    classes are paired, unless their population counts lie further apart than the radius.
    """
    cls = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-math.log(ratio)) + 1e-9).cast("int")
    rows = rows.withColumn("cls", cls)
    cells = rows.groupBy("cls", "pc").count()
    up = Window.partitionBy("cls").orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    cells = durable(cells.select("cls", "pc", F.col("count").alias("room"), F.coalesce(F.sum("count").over(up), F.lit(0)).alias("before")), "cells")
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    cell = F.concat(word(F.col("node")), word(F.col("n").cast("long")), F.col("fp"))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("room"))) / tile).cast("int")
    dealt = rows.join(small(cells), ["cls", "pc"]).select("cls", at.alias("at"), "pc", cell.alias("cell"))
    tiles = dealt.groupBy("cls", "at").agg(F.min("pc").alias("lo"), F.max("pc").alias("hi"), F.listagg("cell").alias("blob"))
    tiles = durable(tiles, "tiles")
    meta = tiles.select("cls", "at", "lo", "hi")
    per = meta.groupBy("cls").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("others"))
    pairs = None
    for up_ in (0, 1):  # the tiles of a class, one row, reach those of the same and of the next class
        found = meta.join(per.select((F.col("cls") - up_).alias("cls"), "others"), "cls").select("cls", "at", "lo", "hi", F.explode("others").alias("o"))
        found = found.where((F.col("o.lo") <= F.col("hi") + radius) & (F.col("o.hi") >= F.col("lo") - radius))
        found = found.where("o.at >= at") if up_ == 0 else found
        found = found.select("cls", "at", (F.col("cls") + up_).alias("cls2"), F.col("o.at").alias("at2"))
        pairs = found if pairs is None else pairs.unionByName(found)
    right = tiles.select(F.col("cls").alias("cls2"), F.col("at").alias("at2"), F.col("blob").alias("blob2"))
    joined = pairs.join(tiles.select("cls", "at", "blob"), ["cls", "at"]).join(right, ["cls2", "at2"])
    n = max(1, min(4096, rows.sparkSession.sparkContext.defaultParallelism * 4))
    mixed = F.xxhash64("cls", "at", "cls2", "at2")
    return joined.select("blob", "blob2", F.expr("cls = cls2 AND at = at2").alias("same"), mixed.alias("to")).repartition(n, "to").drop("to")


def _among(similarity: tuple[int, int]):
    """mapInPandas function over rows (key, node, label, hashes) sorted by key: edges ``(a, b)`` that span the links of each
    run of one key.  Runs that are one label already are left out."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.node.to_numpy()
        if len(nodes) < 2 or rows.label.nunique() == 1:
            return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
        forest = _Forest(len(nodes))
        forest.join(*linked([np.frombuffer(h, np.uint64) for h in rows.hashes], similarity))
        a, b = _star(nodes, forest)
        return pd.DataFrame({"a": a, "b": b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b.key.to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found = [solve(b[s:e]) for s, e in zip(cut[:-1], cut[1:])]
            if found:
                yield pd.concat(found, ignore_index=True)
            rest = b[cut[-1] :]  # the last run may go on in the next batch
        if rest is not None and len(rest):
            yield solve(rest)

    return run


def groups(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = SIMILARITY, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE, room: int = ROOM) -> DataFrame:
    """``(doc_id, component_id)`` of ``docs(doc_id, text)``, for each doc_id that is not null: the smallest doc_id reachable
    over links.

    1. All fingerprints meet in tiles; the components of the pairs within the radius are the candidate groups.
    2. In each candidate group the links are the pairs of a cosine of ``similarity`` or more, counted on whole sets.  Groups
       of over ``room`` sets (or as many bytes as these usually have) are cut in parts; each part meets itself and the next,
       and where that leaves more than one component, all parts of the group meet.
    Only edges that span links leave a task.  Texts of one doc_id link.  Texts without words are one empty set, and link.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lanes, ratio = width // 64, (similarity[0] / similarity[1]) ** 2
    all_ = durable(sketches(docs, words, width), "sketches")
    ones = sum((F.bit_count(F.conv(F.substring(F.hex("fp"), 8 * k + 1, 8), 16, 10).cast("long")) for k in range(width // 32)), F.lit(0))
    nodes = all_.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp")).withColumn("pc", ones.cast("int"))
    nodes = durable(nodes, "nodes")
    maybe = _tile_joins(nodes.select("node", "n", "fp", "pc"), radius, ratio, tile).mapInPandas(_candidates(radius, lanes, ratio), "a long, b long")
    group = components(maybe).select("node", F.col("label").alias("grp"))
    load = nodes.join(group, "node").groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / room), F.ceil(F.sum("n") / (room * 1024))).cast("long").alias("parts"))
    group = durable(group.join(load, "grp").select("node", "grp", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "groups")
    sets = durable(hashed(docs, group, words).join(small(group), "node").withColumn("label", F.col("node")), "sets")
    whole = sets.where("parts = 1").select(F.col("grp").alias("key"), "node", "label", "hashes")
    met = lambda rows: rows.select("key", "node", "label", "hashes").repartition("key").sortWithinPartitions("key").mapInPandas(_among(similarity), "a long, b long")
    edges = durable(met(whole), "links")
    if not group.where("parts > 1").isEmpty():
        key = lambda i, j: F.xxhash64("grp", i, j).alias("key")
        part, parts = F.col("part"), F.col("parts")
        large = sets.where("parts > 1")
        near = F.array(part, F.pmod(part - 1, parts))  # the pair of this part and the next, that of the last and this
        first = durable(met(large.withColumn("i", F.explode(near)).withColumn("key", key(F.col("i"), F.lit(-1)))), "links")
        label = durable(group.where("parts > 1").join(components(first), "node", "left").select("node", "grp", F.coalesce("label", "node").alias("label")), "labels")
        split = label.groupBy("grp").agg((F.min("label") != F.max("label")).alias("split")).where("split").select("grp")
        rest = large.drop("label").join(small(label.join(split, "grp", "left_semi").select("node", "label")), "node")
        other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other")
        rest = rest.select("grp", "node", "label", "hashes", "part", other).where("part <> other")
        edges = edges.unionByName(first).unionByName(met(rest.withColumn("key", key(F.least("part", "other"), F.greatest("part", "other")))))
    label = components(edges.unionByName(_several(all_, nodes.select("s1", "s2", "node"), ["s1", "s2"])))
    of = nodes.join(label, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component_id"))
    return all_.join(of, ["s1", "s2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one of the smallest doc_id.

    Groups are the components of the pairs whose sets of five-word shingles have a cosine, the similarity that SimHash
    estimates, of 4/5 or more: tiles of fingerprints find the pairs, whole sets decide.
    Documents without words stay as they are, each its own group; rows without doc_id stay too.  Of rows that
    repeat a doc_id one stays.
    """
    bounded(docs.sparkSession)
    blank = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))) == 0
    found = groups(docs.where(~blank).select("doc_id", "text"), words, similarity)
    once = without(docs, durable(found.where("doc_id <> component_id").select("doc_id").distinct(), "lose"))
    again = durable(once.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return once
    whole = once.select(F.col("doc_id"), F.xxhash64(*quoted(once.columns)).alias("order"), F.struct(*quoted(once.columns)).alias("row"))
    one = whole.join(small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.struct("order", "row.text")).alias("row"))
    return without(once, again).unionByName(one.select("row.*"))
