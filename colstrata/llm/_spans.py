"""Positions of regular-expression matches in whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import durable


BLANKS = "\t\n\x0b\x0c\r"


def _all(kind: str, pattern: str, words: bool, pieces: Column) -> Column:
    """Array of (kind, idx, gap, len, match, before, after) of the leftmost non-overlapping matches in column text.

    The text between matches (split) and the matches (extract all) alternate, so a match starts where the pieces and
    matches before it end; positions are summed up later, over rows.  Pieces and matches are zipped first: what a
    lambda refers to from outside is computed again for every element, and the text must be split once only.  A text
    without matches is one piece, and is not searched again.
    """
    n = F.size(pieces) - 1
    zipped = F.arrays_zip(F.slice(pieces, 1, n).alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.slice(pieces, 2, n).alias("q"))
    spaced = lambda c: F.translate(c, BLANKS, " " * len(BLANKS))
    row = lambda z, i: F.struct(
        F.lit(kind).alias("kind"),
        i.alias("idx"),
        F.length(z["p"]).alias("gap"),
        F.length(z["m"]).alias("len"),
        z["m"].alias("match"),
        F.substring_index(spaced(z["p"]), " ", -8).alias("before") if words else F.lit(None).cast("string").alias("before"),
        F.substring_index(spaced(z["q"]), " ", 8).alias("after") if words else F.lit(None).cast("string").alias("after"),
    )
    return F.when(n > 0, F.transform(zipped, row)).otherwise(F.array())


def matches(docs: DataFrame, patterns: dict[str, str], words: bool = False) -> DataFrame:
    """Rows ``(rid, doc_id, h, kind, start, end, match, before, after)``: all matches of all patterns in every text of ``docs``.

    start, end: code points, end exclusive.  Every document also has a row of a null kind, so that documents
    without matches stay.  rid tells the rows of ``docs`` apart; h is a hash of the text.  A null text is empty.
    The texts are read once and not shuffled; only the matches are, to sum up positions.  before, after, if ``words``: up to
    eight space-separated pieces beside the match, as far as the next match of the same kind, blanks as spaces.
    """
    shape = "array<struct<kind:string,idx:int,gap:int,len:int,match:string,before:string,after:string>>"
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"rid": F.monotonically_increasing_id(), "h": F.xxhash64("text")})
    mark = F.array(F.struct(*[F.lit(None).alias(x) for x in ("kind", "idx", "gap", "len", "match", "before", "after")])).cast(shape)
    each = [mark]
    for kind, pattern in patterns.items():
        base = base.withColumn(f"p_{kind}", F.split("text", pattern, -1))
        each.append(_all(kind, pattern, words, F.col(f"p_{kind}")).cast(shape))
    rows = durable(base.select("rid", "doc_id", "h", F.explode(F.concat(*each)).alias("m")).select("rid", "doc_id", "h", "m.*"), "matches")
    so_far = Window.partitionBy("rid", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.where("kind IS NOT NULL").withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far))
    found = found.select("rid", "doc_id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "match", "before", "after")
    bare = rows.where("kind IS NULL").select("rid", "doc_id", "h", "kind", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "match", "before", "after")
    return found.unionByName(bare)


def apart(rows: DataFrame, base: Column) -> Column:
    """True on rows that overlap no row for which ``base`` holds; a window over (rid, start), so linear in the spans."""
    w = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return (F.coalesce(before, F.lit(0).cast("long")) <= F.col("start")) & (F.coalesce(after, F.lit(2**62)) >= F.col("end"))


def listed(spans: Column, order: list[str]) -> Column:
    """kind:start:end comma-joined, of an array of structs (start, end, rank, kind) sorted by the named fields."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[x].alias(f"k{i}") for i, x in enumerate(order)], s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
