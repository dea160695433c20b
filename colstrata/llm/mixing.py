"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get.  The whole part
is taken for all; the fractional part is rounded by the pivotal method: two documents whose fractions are open
transfer mass, measured in words so that the words taken stay the same, in a random direction until one of the
two is 0 or 1; directions are drawn so that every document keeps its expected copies.

Documents of over 1 / LARGE of their source's words, so at most LARGE a source, go first: each is paired with all
smaller ones together, which give or take evenly what settles it.  The others are rounded in groups; one document stays
open in each, groups are combined through a tree, level by level, until one open document is left in a source
and is rounded by a draw.  So a source's words miss its target by less than 1 / LARGE of its size, unless a document is
larger than all smaller ones can make up for.

Every group is a task's slice of bounded size (``fan`` documents), keyed by source and a hash, so a source that
holds a third of all rows is many groups.  Draws come from hashes of the row and of its number among equal rows, so
reruns agree and repeated rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import row_index
from ._shared import durable, quoted, small

FAN = 4096
CAP = 3.0
#: A document is large from this part of its source's words on.
LARGE = 1000


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: dict[str | None, float] | None = None, cap: float = CAP) -> DataFrame:
    """``sizes(source, size long)``, one row a source, with ``target double``: the words to take from it.

    Sources by code point, null last, weigh 1, 2, 3, repeating, unless ``weights`` says otherwise, and share the sum of
    all sizes; a target stops at ``cap`` times its source's size and the excess is shared anew by weight until none is
    above.  A source of size 0 takes 0.  Sums are of whole numbers, so they don't depend on the order of rows.
    """
    spark = sizes.sparkSession
    if weights:
        table = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
        table = sizes.alias("t").join(table.alias("w"), F.expr("t.source <=> w.source"), "left").select("t.*", F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    else:
        ranked = row_index(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], "at").drop("last")
        table = ranked.withColumn("weight", (1 + F.col("at") % 3).cast("double")).drop("at")
    table = durable(table.withColumn("most", F.col("size") * F.lit(float(cap))), "sources")
    total = table.agg(F.sum("size")).first()[0] or 0
    level = -1.0  # words for a weight of 1; sources that would get more than their cap stop there
    while True:
        stopped = F.col("weight") * F.lit(level) > F.col("most")
        got = table.agg(F.sum(F.when(stopped, F.col("size"))).alias("size"), F.sum(F.when(~stopped, F.col("weight").cast("decimal(30,12)"))).alias("weight")).first()
        new = (total - cap * (got["size"] or 0)) / float(got["weight"]) if got["weight"] else 0.0
        if new <= level:
            break
        level = new
    shared = F.col("weight") * F.lit(max(level, 0.0))
    return table.select("source", "size", F.when(shared > F.col("most"), F.col("most")).otherwise(shared).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round the fractions ``p`` (0 to 1) of documents of ``size`` > 0 by pairwise transfers of words; all but one of
    the result are 0 or 1.  ``draw``: a number in [0, 1) for each transfer, taken in order."""
    out = p.copy()
    n = len(out)
    open_ = -1
    p_, s_, d_ = out.tolist(), size.tolist(), draw.tolist()
    for i in range(n):
        if p_[i] <= 1e-12 or p_[i] >= 1 - 1e-12:
            p_[i] = round(p_[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up = min((1 - p_[i]) * s_[i], p_[j] * s_[j])  # words that can go from j to i
        down = min(p_[i] * s_[i], (1 - p_[j]) * s_[j])
        if d_[i] * (up + down) < down:
            p_[i] += up / s_[i]
            p_[j] -= up / s_[j]
        else:
            p_[i] -= down / s_[i]
            p_[j] += down / s_[j]
        done = [k for k in (i, j) if p_[k] <= 1e-9 or p_[k] >= 1 - 1e-9]
        for k in done:
            p_[k] = float(round(p_[k]))
        rest = [k for k in (i, j) if k not in done]
        open_ = rest[0] if rest else -1
    return np.array(p_)


def _level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (source number, slot, order): each run of one (source number, slot) is rounded."""
    rest = None
    columns = ["rid", "src", "size", "p", "draw", "o"]
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        src, slot = b.src.to_numpy(), b.slot.to_numpy()
        cut = int(np.flatnonzero((src == src[-1]) & (slot == slot[-1]))[0])  # the last run may go on in the next batch
        done, rest = b[:cut], b[cut:]
        if len(done):
            yield _round(done)[columns]
    if rest is not None and len(rest):
        yield _round(rest)[columns]


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    src, slot = rows.src.to_numpy(), rows.slot.to_numpy()
    cut = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (slot[1:] != slot[:-1]), True])
    p, size, draw = rows.p.to_numpy(), rows["size"].to_numpy().astype(float), rows.draw.to_numpy()
    return rows.assign(p=np.concatenate([pivot(p[a:b], size[a:b], draw[a:b]) for a, b in zip(cut[:-1], cut[1:])]))


def settle(p: float, size: np.ndarray, draw: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """(0 or 1 for each large document, the fraction that the smaller ones have then).

    All documents of a source, ``total`` words, have the fraction ``p``; each large one in turn is drawn, and the rest
    share evenly what it leaves or takes.  The rest's fraction stays p in expectation, until it can't make up any more.
    """
    took = np.zeros(len(size), np.int64)
    for k, (s, d) in enumerate(zip(size.tolist(), draw.tolist())):
        took[k] = d < p
        rest = total - s
        p = min(1.0, max(0.0, (p * total - took[k] * s) / rest)) if rest > 0 else 0.0
        total = rest
    return took, p


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (rid, src, size, total, p, draw) of large documents, sorted by src and falling size; at most LARGE a source."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        cut = int(np.flatnonzero(b.src.to_numpy() == b.src.iat[-1])[0])
        done, rest = b[:cut], b[cut:]
        if len(done):
            yield _settle_all(done)
    if rest is not None and len(rest):
        yield _settle_all(rest)


def _settle_all(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for src, part in rows.groupby("src", sort=False):
        took, p = settle(float(part.p.iat[0]), part["size"].to_numpy().astype(float), part.draw.to_numpy(), float(part.total.iat[0]))
        out.append(pd.DataFrame({"rid": part.rid.to_numpy(), "src": src, "took": took, "p": p}))
    return pd.concat(out, ignore_index=True)


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with ``dup``: the number of a row among rows equal in doc_id, source and text, from 0.  Equal rows are counted by
    partition first, so that very many of them meet in no task."""
    same = ["doc_id", "source", "h"]
    part = F.shiftrightunsigned("rid", 33).alias("part")
    count = base.select(*same, part).groupBy(*same, "part").count()
    groups = durable(count.groupBy(*same).agg(F.sum("count").alias("n"), F.collect_list(F.struct("part", "count")).alias("parts")).where("n > 1"), "repeats")
    if groups.isEmpty():
        return base.withColumn("dup", F.lit(0).cast("long"))
    up = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.select(*same, F.explode("parts").alias("x")).select(*same, "x.part", F.col("x.count").alias("rows"))
    offset = parts.select(*same, "part", F.coalesce(F.sum("rows").over(up), F.lit(0)).alias("before"))
    b, o = base.withColumn("part", part).alias("b"), small(durable(offset, "offsets")).alias("o")
    joined = b.join(o, F.expr("b.doc_id <=> o.doc_id AND b.source <=> o.source AND b.h = o.h AND b.part = o.part"), "left").select("b.*", "o.before")
    inside = F.row_number().over(Window.partitionBy(*same, "part").orderBy("rid")) - 1
    return joined.withColumn("dup", F.when(F.col("before").isNotNull(), F.col("before") + inside).otherwise(0)).drop("part", "before")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, cap: float = CAP, seed: int = 42, fan: int = FAN) -> DataFrame:
    """``(doc_id, h, source, size, source_size, target, copies)`` (h: a hash of the text), one row per row of ``docs(doc_id, text, source)``.

    copies: how often the mix takes the document, 0 to ``cap`` (a whole number).  Documents without words have size 0
    and no copies.  A null source is a source of its own.  Repeated rows are documents each; an empty table gives no rows.
    """
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)).alias("h")).withColumn("rid", F.monotonically_increasing_id())
    base = durable(base, "sizes")
    by = base.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"))
    by = durable(by, "by")
    aim = targets(by.select("source", "size"), weights, cap).select("source", "target")
    table = by.alias("b").join(aim.alias("a"), F.expr("a.source <=> b.source"))
    table = table.select("b.source", F.col("b.size").alias("source_size"), "a.target", F.greatest(F.lit(1), F.ceil(F.col("b.n") / fan)).alias("slots"))
    table = durable(table.withColumn("src", F.monotonically_increasing_id()), "targets")  # written: the numbers stay
    full = base.join(small(table).withColumnRenamed("source", "own"), base.source.eqNullSafe(F.col("own"))).drop("own")
    ratio = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = _numbered(full).withColumn("whole", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    full = durable(full, "full")
    unit = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 52)) / float(1 << 52)
    o = F.xxhash64("h", "doc_id", "dup")
    open_ = full.where("p > 0 AND size > 0").select("rid", "src", "size", "source_size", "p", "slots", o.alias("o"))
    large = open_.where(F.col("size") * LARGE > F.col("source_size"))
    large = large.select("rid", "src", "size", F.col("source_size").alias("total"), "p", unit("o", F.lit(seed), F.lit(-1)).alias("draw"), "o").repartition("src").sortWithinPartitions("src", F.desc("size"), "o")
    first = durable(large.drop("o").mapInPandas(_settled, "rid long, src long, took long, p double"), "large")
    after = durable(first.groupBy("src").agg(F.min("p").alias("after")), "after")
    rest = open_.where(F.col("size") * LARGE <= F.col("source_size")).join(small(after), "src", "left").withColumn("p", F.coalesce("after", "p"))
    level, slots = 0, int(table.agg(F.max("slots")).first()[0] or 1)
    decided = first.where("took = 1").select("rid").unionByName(rest.where("p >= 1 - 1e-12").select("rid"))
    live = rest.where("p > 1e-12 AND p < 1 - 1e-12").select("rid", "src", "size", "p", F.pmod(F.xxhash64("o", F.lit(seed)), F.col("slots")).alias("slot"), "o")
    while True:
        order = live.withColumn("draw", unit("o", F.lit(seed), F.lit(level))).repartition("src", "slot").sortWithinPartitions("src", "slot", F.desc("size"), "o")
        out = durable(order.select("rid", "src", "slot", "size", "p", "draw", "o").mapInPandas(_level, "rid long, src long, size long, p double, draw double, o long"), "level")
        decided = decided.unionByName(out.where("p >= 1").select("rid"))
        still = out.where("p > 0 AND p < 1")
        if slots <= 1:
            decided = decided.unionByName(still.where(F.col("draw") < F.col("p")).select("rid"))
            break
        slots = -(-slots // fan)
        level += 1
        live = still.select("rid", "src", "size", "p", F.pmod(F.xxhash64("o", F.lit(level)), F.lit(slots)).alias("slot"), "o")
    taken = decided.withColumn("extra", F.lit(1).cast("long"))
    out = full.join(taken, "rid", "left")
    return out.select("doc_id", "h", "source", "size", "source_size", "target", (F.col("whole").cast("long") + F.coalesce("extra", F.lit(0).cast("long"))).alias("copies"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, cap: float = CAP, seed: int = 42, fan: int = FAN) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it has copies.

    Rows equal in doc_id and text count as one document here; it comes as often as all of them have copies.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed))
    found = mix(docs, weights, cap, seed, fan)
    count = durable(found.groupBy("doc_id", "h").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")), "copies").alias("c")
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), "doc_id", hashed.alias("h")).alias("t")  # a struct: no name can clash
    on = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h"))
    again = count.where("c.rows > 1")
    if not again.isEmpty():
        one = keyed.join(again, on, "left_semi").dropDuplicates(["doc_id", "h"])
        keyed = keyed.join(again, on, "left_anti").unionByName(one).alias("t")
    out = keyed.join(count.where("c.copies > 0"), on)
    return out.select("t.row", F.explode(F.sequence(F.lit(1), F.col("c.copies")))).select("row.*")
