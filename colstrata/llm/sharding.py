"""Sharding by a k-d tree over document metadata.

A node that is to become several leaves is cut along its widest metadata dimension (length, id, source, language;
width relative to the whole table) at the weighted quantile that gives each side its share of the bytes: the
median for an even number of leaves.  Weights are bytes, so the leaves' sizes are near equal.  Quantiles are
exact but for the rows of one cell: all nodes of a level are cut together by a histogram over the narrow
metadata and a second one that refines the cell in which the quantile falls.  Within equal values a hash decides, so a
source that holds a third of all rows is cut like any other range.

The tree is a table, one row a node, and rows carry the number of their node: a level is joins with that table and sums
per node and cell, whatever the number of leaves; nothing is gathered on the driver.

Rows of equal text are one point, the least id, source and language that the text has, so they share a leaf.  A group of
copies that weighs more than ``unit`` of a leaf's share can't stay whole in leaves of near equal size: its rows are
points of their own.

Only the narrow metadata (a few longs a row) is written, once a level; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import durable, release, small

BINS = 4096
DIMS = ("x_chars", "x_id", "x_source", "x_lang")
#: Part of a leaf's share of bytes up to which copies of one text are kept together.
UNIT = 0.005


def metadata(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, t1, t2, x_...)`` of ``docs(doc_id, text, source, lang)``; t1, t2 tell texts apart.

    size: UTF-8 bytes of the text (null: none) plus 8.  Dimensions are whole numbers: the length in code points, the id
    (null: -1), and the source and language as 16 bits of a hash.
    """
    text = F.coalesce("text", F.lit(""))
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 16)).cast("double")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.length(text).cast("double").alias("x_chars"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("x_id"),
        code("source").alias("x_source"),
        code("lang").alias("x_lang"),
    )


def points(meta: DataFrame, most: float) -> DataFrame:
    """``meta`` with dimensions that copies of one text share, where the copies weigh at most ``most`` bytes together; each
    dimension gets a tie-breaker in [0, 1), of the text alone for these and of id and text for others."""
    count = meta.groupBy("t1", "t2").agg(F.count("*").alias("m"), F.sum("size").alias("mass"), *[F.min(x).alias(f"m_{x}") for x in DIMS])
    kept = durable(count.where((F.col("m") > 1) & (F.col("mass") <= most)).drop("m"), "copies")
    joined = meta.join(small(kept), ["t1", "t2"], "left")
    own = F.pmod(F.xxhash64("doc_id", "t1"), F.lit(1 << 20)) / float(1 << 20)
    shared = F.pmod("t1", F.lit(1 << 20)) / float(1 << 20)
    u = F.when(F.col("mass").isNull(), own).otherwise(shared)
    return joined.select("doc_id", "size", "text_crc32", *[(F.coalesce(f"m_{x}", x) + u).alias(x) for x in DIMS])


def cut(rows: DataFrame, leaves: int, bins: int = BINS) -> DataFrame:
    """``rows(size, x_...)`` with ``shard``: the tree's leaf, from 0, left to right."""
    spark = rows.sparkSession
    live = durable(rows.withColumn("node", F.lit(0).cast("long")), "points")
    whole = live.agg(*[(F.max(x) - F.min(x)).alias(x) for x in DIMS]).first()
    width = {x: max(whole[x] or 0.0, 1e-9) for x in DIMS}
    # a node: the first of its leaves and their number, so that node numbers are the first leaves' themselves
    nodes = spark.createDataFrame([(0, leaves)], "node long, leaves long")
    for _ in range(max(0, leaves - 1).bit_length()):
        edge = [f(x).alias(f"{n}_{x}") for x in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = live.groupBy("node").agg(F.sum("size").alias("mass"), *edge).join(nodes.where("leaves > 1"), "node")
        spread = F.greatest(*[F.struct(((F.col(f"hi_{x}") - F.col(f"lo_{x}")) / width[x]).alias("w"), F.lit(-k).alias("k"), F.lit(x).alias("dim"), F.col(f"lo_{x}").alias("lo"), F.col(f"hi_{x}").alias("hi")) for k, x in enumerate(DIMS)])
        spans = stats.select("node", "leaves", (F.col("mass") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("aim"), spread.alias("s"))
        spans = spans.select("node", "leaves", "aim", F.lit(0).cast("double").alias("below"), "s.dim", "s.lo", "s.hi")
        for _ in range(2):  # each pass narrows the range, of which ``below`` bytes come before, to one of its bins
            spans = durable(spans.drop("upto"), "spans")
            value = F.coalesce(*[F.when(F.col("dim") == x, F.col(x)) for x in DIMS])
            step = F.greatest(F.lit(1e-12), F.col("hi") - F.col("lo")) / bins
            inside = live.join(small(spans), "node").withColumn("v", value).where("v >= lo AND v <= hi")
            cell = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / step)).cast("int")
            sums = inside.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("b"))
            w = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows a node
            upto = sums.withColumn("upto", F.sum("b").over(w)).join(small(spans), "node").withColumn("upto", F.col("upto") + F.col("below"))
            last = F.max(F.struct("cell", "b", "upto"))
            hit = F.min(F.when(F.col("upto") >= F.col("aim"), F.struct("cell", "b", "upto")))
            found = upto.groupBy("node", "leaves", "aim", "dim", "lo", "hi").agg(F.coalesce(hit, last).alias("c")).withColumn("step", step)
            lo = F.col("lo") + F.col("c.cell") * F.col("step")
            hi = F.when(F.col("c.cell") < bins - 1, lo + F.col("step")).otherwise(F.col("hi"))
            spans = found.select("node", "leaves", "aim", (F.col("c.upto") - F.col("c.b")).cast("double").alias("below"), "dim", lo.alias("lo"), hi.alias("hi"), F.col("c.upto").alias("upto"))
        # the cut is before or after the last cell, whichever is nearer to the aim; a cell of the whole range goes left
        at = F.when(F.col("upto") - F.col("aim") < F.col("aim") - F.col("below"), F.col("hi")).otherwise(F.col("lo"))
        cuts = durable(spans.select("node", "leaves", "dim", at.alias("cut")), "cuts")
        half = F.floor(F.col("leaves") / 2)
        joined = live.join(small(cuts), "node", "left")
        value = F.coalesce(*[F.when(F.col("dim") == x, F.col(x)) for x in DIMS])
        to = F.when(F.col("dim").isNotNull() & (value >= F.col("cut")), F.col("node") + half).otherwise(F.col("node")).cast("long")
        after = durable(joined.select("doc_id", "size", "text_crc32", *DIMS, to.alias("node")), "points")
        release(live)
        live = after
        low = nodes.where("leaves > 1").select("node", half.cast("long").alias("leaves"))
        high = nodes.where("leaves > 1").select((F.col("node") + half).cast("long").alias("node"), (F.col("leaves") - half).cast("long").alias("leaves"))
        nodes = durable(nodes.where("leaves <= 1").unionByName(low).unionByName(high), "nodes")
    return live.withColumn("shard", F.col("node").cast("int")).drop("node")


def shards(docs: DataFrame, n: int = 24, target_bytes: int | None = None, bins: int = BINS, block: int = 65_536, unit: float = UNIT) -> DataFrame:
    """``(doc_id, size, text_crc32, shard int, slot long)``, one row per row of ``docs``.

    ``n`` leaves, or as many as bring a leaf to at most ``target_bytes`` on average.  shard: 0 to n - 1 in the tree's
    order; slot: from 0 without gaps in each shard.  Null and empty texts have size 8 and the CRC 0.  Copies of a text share
    a shard, unless they weigh over ``unit`` of a shard's bytes together.  An empty table gives no rows; columns beyond
    doc_id, text, source and lang are ignored.  Repeated rows are placed each.
    """
    meta = durable(metadata(docs), "meta")
    total = meta.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    if target_bytes:
        n = max(1, -(-(total.bytes or 0) // target_bytes))
    placed = cut(points(meta, unit * (total.bytes or 0) / n), n, bins)
    blocks = max(1, min(1024, total.rows // (n * block)))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    count = placed.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offset = durable(count.select("shard", "block", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("rank", rank).join(small(offset), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
