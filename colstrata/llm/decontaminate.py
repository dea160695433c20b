"""Benchmark decontamination: prefix-filtered set join of word shingles, in DataFrame functions only.

Every item is cut in windows of ``window`` words (an item of fewer words is one window).  A window is the set of
its positioned shingles; a document holds the window where it holds all of them at the same offsets.

1. One pass over the documents keeps the positions of shingles that any item has (a join with the items'
   shingles; words themselves are compared, so equal hashes do no harm).
2. Shingles are ordered by how often the corpus has them.  A window that has a shingle the corpus lacks can't
   occur.  Of the others only the rarest shingle, the necessary prefix, is joined with the positions.
3. Length and positional bounds drop starts outside the document; the rest is verified exactly: the shingles
   found from start to end must be the window's, one by one.

The text is read once and shuffled never: what is shuffled are positions of shared shingles.  Items' shingles are
broadcast up to a checked number; beyond it a bit map of their hashes, of bounded size, is, so that even then only
positions that may be shared are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, durable, small, without

WINDOW = 13
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longs of the bit map that stands in for the items' shingles beyond BROADCAST_ROWS (16 MB at most).
MAP_LONGS = 1 << 21
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of ``text``: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAK, -1), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items(item_id, text)``: ``(win long, len int, tokens array, item_ids array<string>)``."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - m + 1)
    cut = w.select("item_id", m.alias("len"), F.explode(F.transform(starts, lambda s: F.slice("w", s, m))).alias("tokens"))
    cut = cut.groupBy("len", "tokens").agg(F.collect_set("item_id").alias("item_ids"))
    return cut.withColumn("win", F.monotonically_increasing_id())


def _positions(docs: DataFrame, shingles: DataFrame, width: int, first: bool) -> DataFrame:
    """Rows ``(rid, doc_id, n_words, p, vid)`` where a document has one of ``shingles``; if ``first``, also a row of
    p = -1 for every document."""
    start = -1 if first else 0
    base = docs.select("rid", "doc_id", "w", F.size("w").alias("n_words"))
    at = base.select("*", F.explode(F.sequence(F.lit(start), F.greatest(F.size("w") - width, F.lit(start)))).alias("p"))
    took = [F.get("w", F.when(F.col("p") >= 0, F.col("p") + k)).alias(f"t{k}") for k in range(width)]
    rows = at.select("rid", "doc_id", "n_words", "p", *took)
    key = F.when((F.col("p") >= 0) & (F.col("p") + width <= F.col("n_words")), F.xxhash64(*[f"t{k}" for k in range(width)]))
    rows = rows.withColumn("h", key)
    voc = shingles.select(F.xxhash64(*[F.col("tokens")[k] for k in range(width)]).alias("h"), "vid", *[F.col("tokens")[k].alias(f"v{k}") for k in range(width)])
    same = F.lit(True)
    for k in range(width):
        same &= F.col(f"t{k}") == F.col(f"v{k}")
    if voc.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(voc), "h", "left").where((F.col("p") == -1) | (F.col("vid").isNotNull() & same))
        return joined.select("rid", "doc_id", "n_words", "p", "vid")
    bits = _bit_map(voc.select("h"))
    long = F.expr(f"get(bits, cast(pmod(shiftright(h, 6), {MAP_LONGS}) as int))")
    may = rows.where("p >= 0").join(F.broadcast(bits)).withColumn("long", long).where("(shiftrightunsigned(long, cast(pmod(h, 64) as int)) & 1) = 1").drop("long")
    joined = may.drop("bits").join(voc, "h").where(same).select("rid", "doc_id", "n_words", "p", "vid")
    return joined.unionByName(rows.where("p = -1").select("rid", "doc_id", "n_words", "p", F.lit(None).cast("long").alias("vid")))


def _bit_map(hashes: DataFrame) -> DataFrame:
    """One row ``(bits array<long>)``, MAP_LONGS long: bit h mod 64 of long h / 64 is set for every ``h``."""
    at = F.pmod(F.shiftright("h", 6), F.lit(MAP_LONGS)).alias("at")
    one = F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")
    cells = hashes.groupBy(at).agg(F.bit_or(one).alias("b"))
    every = hashes.sparkSession.range(MAP_LONGS).toDF("at").join(cells, "at", "left").select("at", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return durable(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]).alias("bits")), "bits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, item_ids array<string>, n_whole)``, one row per row of ``docs(doc_id, text)``.

    n_hit: words inside any occurrence of a window; item_ids: the items with occurring windows, sorted as strings;
    n_whole: places where a window of full size starts, not one of a shorter item.
    Null, empty and wordless texts have no words and no hits; items without words have no windows; repeated rows
    and rows without doc_id are each judged alone; an empty table of items hits nothing; other columns are ignored.
    """
    win = durable(windows(items.select("item_id", "text"), window), "windows")
    sets = win.select("win", "len", F.least(F.col("len"), F.lit(shingle)).alias("k"), "tokens")
    each = F.transform(F.sequence(F.lit(0), F.col("len") - F.col("k")), lambda j: F.struct(j.alias("j"), F.slice("tokens", j + 1, F.col("k")).alias("tokens")))
    each = sets.select("win", "len", "k", F.explode(each).alias("e")).select("win", "len", "k", "e.j", "e.tokens")
    voc = durable(each.select("k", "tokens").distinct().withColumn("vid", F.monotonically_increasing_id()), "shingles")
    each = durable(each.join(voc, ["k", "tokens"]).select("win", "len", "k", "j", "vid"), "sets")
    base = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("rid", F.monotonically_increasing_id())
    widths = sorted(r.k for r in voc.select("k").distinct().collect())  # at most ``shingle`` values
    if len(widths) > 1:  # several passes: the numbers of the rows must be the same in all of them
        kept = durable(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "numbered")
        base = kept.select("doc_id", words(F.col("text")).alias("w"), "rid")
    found = None
    for width in widths or [shingle]:
        if found is None:
            found = durable(_positions(base, voc.where(F.col("k") == width), width, True).withColumn("k", F.lit(width)), "found")
        else:  # only where items have fewer words than a shingle
            more = _positions(base, voc.where(F.col("k") == width), width, False).withColumn("k", F.lit(width))
            found = durable(found.unionByName(more), "found")
    hits = found.where("p >= 0").select("rid", "n_words", "k", "p", "vid")
    often = hits.groupBy("vid").agg(F.count("*").alias("n"))
    order = each.join(small(durable(often, "often")), "vid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = order.groupBy("win", "len", "k").agg(F.min(F.struct("n", "vid", "j")).alias("first"), F.sort_array(F.collect_list(F.struct("j", "vid"))).alias("all"))
    prefix = prefix.where("first.n > 0").join(win.select("win", "item_ids"), "win")
    prefix = durable(prefix.select("win", "len", "k", "first.vid", F.col("first.j").alias("j"), F.col("all.vid").alias("vids"), "item_ids"), "prefix")
    near = Window.partitionBy("rid", "k").orderBy("p").rowsBetween(-window, window)
    placed = hits.withColumn("near", F.collect_list(F.struct("p", "vid")).over(near))
    tries = placed.join(small(prefix), ["k", "vid"]).withColumn("s", F.col("p") - F.col("j"))
    tries = tries.where("s >= 0 AND s + len <= n_words")
    inside = F.filter("near", lambda c: (c["p"] >= F.col("s")) & (c["p"] <= F.col("s") + F.col("len") - F.col("k")))
    held = tries.where(inside["vid"] == F.col("vids")).select("rid", "s", "len", "item_ids")
    by = held.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s", "len"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["s"] + x["len"]).alias("end")),
    )["n"]
    whole = F.size(F.filter("at", lambda x: x["len"] >= window)).cast("long")
    by = by.select("rid", covered.cast("long").alias("n_hit"), "item_ids", whole.alias("n_whole"))
    out = found.where("p = -1").select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(by, "rid", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_whole", F.lit(0).cast("long")).alias("n_whole"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``items``.

    A document goes if a whole window of ``window`` words of an item occurs in it, however long it is; items of fewer
    words are common phrases, and a document goes for them only if at least a twentieth of its words lie in windows.
    A doc_id goes if any row with it does; rows without doc_id stay.  All columns come back, in their order.
    """
    bad = contamination(docs, items, window, shingle).where("(n_whole > 0 OR (n_hit > 0 AND 20 * n_hit >= n_words)) AND doc_id IS NOT NULL")
    return without(docs, durable(bad.select("doc_id").distinct(), "bad"))
