"""Joins: equi, first-match, pairing, membership, theta, as-of, and their counting forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, Ranges, bisect, running_sum, spare

THETA = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "ne": "<>"}
#: Rows that a side may have to be broadcast on request; beyond it the planner decides.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``rows`` rows (counted by a limit, so the check is cheap), else ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join with all matches; the planner picks broadcast, shuffled hash or sort merge, and splits skewed keys."""
    return left.join(right, on, how)


def merge_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def first_match(probe: DataFrame, build: DataFrame, on: str, row: str, how: str = "inner") -> DataFrame:
    """At most one match a probe row: of the build rows with its key the last by ``row``.  Duplicates of the build side
    are reduced before the join, so it can't multiply rows."""
    (held,) = spare(probe, "build")
    last = build.groupBy(on).agg(F.max_by(F.struct(*[c for c in build.columns if c != on]), row).alias(held))
    return probe.join(last, on, how).select(*probe.columns, *[F.col(f"{held}.{c}").alias(c) for c in build.columns if c != on])


def pair_join(left: DataFrame, right: DataFrame, on: str, left_order: str, right_order: str) -> DataFrame:
    """Pairs the i-th row of a key on the left with the i-th on the right."""
    (pair,) = spare(left, "pair", also=right.columns)
    number = lambda df, order: df.withColumn(pair, F.row_number().over(Window.partitionBy(on).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [on, pair]).drop(pair)


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def contains(probe: DataFrame, build: DataFrame, on: str) -> DataFrame:
    """``probe`` with ``found``: whether the build side has the key (a null key is not found)."""
    (hit,) = spare(probe, "hit")
    keys = build.select(on).where(F.col(on).isNotNull()).distinct().withColumn(hit, F.lit(True))
    return probe.join(keys, on, "left").withColumn("found", F.coalesce(hit, F.lit(False))).drop(hit)


def lookup(probe: DataFrame, build: DataFrame, on: str, row: str, missing: int = -1) -> DataFrame:
    """``probe`` with ``row_id``: the first build row of its key, ``missing`` if there is none."""
    first = build.groupBy(on).agg(F.min(row).alias("row_id"))
    return probe.join(first, on, "left").withColumn("row_id", F.coalesce("row_id", F.lit(missing).cast("long")))


def theta_join(left: DataFrame, right: DataFrame, left_value: str, op: str, right_value: str, limit_rows: int = 100_000, rows: int = RANGE_ROWS) -> DataFrame:
    """Pairs with ``left_value op right_value`` (eq, lt, le, gt, ge, ne), the columns of both sides; nulls make no pair.

    Equality is an equi join.  Else, if either side has at most ``limit_rows`` rows, it is broadcast.  Two large sides are
    joined by ranges: the right side is dealt to ranges of its value, and each left row meets only those ranges
    that can hold a match, all but one of which match whole; so the work follows the result, which may be as large as the product.
    """
    condition = F.expr(f"_l.`{left_value}` {THETA[op]} _r.`{right_value}`")
    if op == "eq":
        return left.alias("_l").join(right.alias("_r"), condition)
    if right.limit(limit_rows + 1).count() <= limit_rows:
        return left.alias("_l").join(F.broadcast(right).alias("_r"), condition)
    if left.limit(limit_rows + 1).count() <= limit_rows:
        return F.broadcast(left).alias("_l").join(right.alias("_r"), condition)
    if op == "ne":
        both = [theta_join(left, right, left_value, x, right_value, limit_rows, rows) for x in ("lt", "gt")]
        return both[0].union(both[1])
    dealt = Ranges(right.where(F.col(right_value).isNotNull()), [right_value], rows)
    ends, to = spare(left, "ends", "to")
    per = dealt.df.groupBy(dealt.part).agg(F.min(right_value).alias("lo"), F.max(right_value).alias("hi"))
    table = per.agg(F.sort_array(F.collect_list(F.struct(F.col(dealt.part).alias("part"), "lo", "hi"))).alias(ends))  # a row a range
    v = F.col(f"`{left_value}`")
    # ranges are in order, so those with a match are the last ones (lt, le) or the first ones (gt, ge)
    side, beyond = ("hi", op == "le") if op in ("lt", "le") else ("lo", op == "gt")
    value = lambda mid: F.element_at(ends, mid)[side]
    passed = bisect(F.size(ends), 17, lambda mid: (value(mid) < v) if beyond else (value(mid) <= v))
    some = F.sequence(passed + 1, F.size(ends)) if op in ("lt", "le") else F.sequence(F.lit(1), passed)
    wanted = F.when(passed < F.size(ends), some) if op in ("lt", "le") else F.when(passed > 0, some)
    spread = left.where(v.isNotNull()).join(F.broadcast(table)).withColumn(to, F.explode(F.transform(wanted, lambda i: F.element_at(ends, i)["part"])))
    out = spread.alias("_l").join(dealt.df.alias("_r"), (F.col(f"_l.{to}") == F.col(f"_r.{dealt.part}")) & condition)
    return out.select(*[F.col(f"_l.`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`") for c in right.columns])


def count_theta(left: DataFrame, right: DataFrame, left_value: str, op: str, right_value: str) -> DataFrame:
    """``(pairs)``: how many pairs a theta join has, without making them: running counts over the union of distinct
    values, so two large sides cost a sort of their distinct values."""
    lv = left.where(F.col(left_value).isNotNull()).groupBy(F.col(left_value).alias("v")).agg(F.count("*").alias("l"), F.lit(0).cast("long").alias("r"))
    rv = right.where(F.col(right_value).isNotNull()).groupBy(F.col(right_value).alias("v")).agg(F.lit(0).cast("long").alias("l"), F.count("*").alias("r"))
    both = lv.unionByName(rv).groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both = running_sum(both, F.col("r"), ["v"], "upto").join(F.broadcast(right.agg(F.count(right_value).alias("total"))))  # one row
    total_r, upto = F.col("total"), F.col("upto")
    matches = {"eq": F.col("r"), "ne": total_r - F.col("r"), "gt": upto - F.col("r"), "ge": upto, "lt": total_r - upto, "le": total_r - upto + F.col("r")}[op]
    return both.withColumn("m", matches).agg(F.coalesce(F.sum(F.col("l") * F.col("m")), F.lit(0)).cast("long").alias("pairs"))


def theta_groups(left: DataFrame, right: DataFrame, key: str, left_value: str, op: str, right_value: str, of: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``(key, n, lo, hi)`` of the left keys that have theta pairs: how many pairs, and the least and greatest ``of`` of their
    right rows, without making them: running aggregates over the union of distinct values, in ranges of ``rows`` values."""
    v = F.col("v")
    values = left.select(F.col(f"`{left_value}`").alias("v")).where(v.isNotNull()).distinct()
    side = right.select(F.col(f"`{right_value}`").alias("v"), F.col(f"`{of}`").alias("of")).where(v.isNotNull())
    per = side.groupBy("v").agg(F.count("*").alias("n"), F.min("of").alias("lo"), F.max("of").alias("hi"))
    both = per.unionByName(values, allowMissingColumns=True).groupBy("v").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if op == "eq":
        found = both.select("v", F.struct("n", "lo", "hi").alias("m"))
    else:
        r = Ranges(both, ["v"], rows)
        whole = r.df.groupBy(r.part).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        over = lambda w: F.struct(F.sum("n").over(w).alias("n"), F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
        # values below are those before a row in the order, values above those before it in the opposite order
        orders = [c for c, ops in (("asc", ("gt", "ge", "ne")), ("desc", ("lt", "le", "ne"))) if op in ops]
        sort = lambda c, d: getattr(F.col(c), d)()
        before = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
        last = 0 if op in ("le", "ge") else -1
        inside = r.df.select(r.part, "v", *[over(before(Window.partitionBy(r.part).orderBy(sort("v", d)), last)).alias(f"in_{d}") for d in orders])
        # ranges that match whole: one row a range
        outside = whole.select(r.part, *[over(before(Window.partitionBy(F.lit(0)).orderBy(sort(r.part, d)), -1)).alias(f"out_{d}") for d in orders])
        sums = [F.col(f"{at}_{d}") for d in orders for at in ("in", "out")]
        m = F.struct(sum(F.coalesce(s["n"], F.lit(0)) for s in sums).alias("n"), F.least(*[s["lo"] for s in sums]).alias("lo"), F.greatest(*[s["hi"] for s in sums]).alias("hi"))
        found = inside.join(F.broadcast(outside), r.part).select("v", m.alias("m"))
    rest = left.select(F.col(f"`{key}`").alias("key"), F.col(f"`{left_value}`").alias("value"))
    hit = rest.join(found.where("m.n > 0"), F.col("value") == v)
    return hit.groupBy(F.col("key").alias(key)).agg(F.sum("m.n").alias("n"), F.min("m.lo").alias("lo"), F.max("m.hi").alias("hi"))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` in ``[low, high]`` of ``ranges``: an equi join on cells of ``width``, then the exact test.  A range
    is repeated for each cell that it touches; choose ``width`` near the usual length of a range."""
    (at,) = spare(points, "cell", also=ranges.columns)
    cell = lambda c: F.floor(F.col(c) / width)
    cells = ranges.where(F.col(low) <= F.col(high)).withColumn(at, F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn(at, cell(value)).join(cells, at).where(f"{value} BETWEEN {low} AND {high}").drop(at)


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: str, alias: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Each left row with the latest right ``value`` at or before its time, null if there is none; null keys are one key.

    Both sides are put in one stream in the order of key and time, dealt to ranges, and the last value is carried on: no
    pairs, and no key is a single task.  What a range takes over from those before is one row a range.
    """
    # the left row is a struct, so no name can clash
    a = left.select(on, F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.struct(*left.columns).alias("row"))
    b = right.select(on, F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    both = a.toDF("k", "t", "side", "v", "row").unionByName(b.toDF("k", "t", "side", "v", "row"))
    r = Ranges(both, ["k", "t", "side"], rows)
    w = Window.partitionBy(r.part, "k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = r.df.withColumn("last", F.last("v", ignorenulls=True).over(w))
    if not r.one:  # keys that go on from earlier ranges: at most one a range
        per = r.df.where("side = 0 AND v IS NOT NULL").groupBy(r.part, "k").agg(F.max_by("v", "t").alias("v"))
        parts = r.df.select(r.part, "k").distinct().join(per.withColumnRenamed("k", "k2").withColumnRenamed(r.part, "part2"), (F.col(r.part) == F.col("part2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
        before = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy(r.part).rowsBetween(Window.unboundedPreceding, -1))
        late = parts.select(F.col(r.part).alias("part2"), F.col("k").alias("k2"), before.alias("late")).where("late IS NOT NULL")
        carried = carried.join(F.broadcast(late), (F.col(r.part) == F.col("part2")) & F.col("k").eqNullSafe(F.col("k2")), "left").withColumn("last", F.coalesce("last", "late"))
    return carried.where("side = 1").select("row.*", F.col("last").alias(alias))


def count_pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``(pairs)``: the number of equi-join pairs, from counts per key; a hot key costs one row a side."""
    a, b = left.groupBy(on).agg(F.count("*").alias("l")), right.groupBy(on).agg(F.count("*").alias("r"))
    return a.join(b, on).agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).cast("long").alias("pairs"))


def count_merged(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``(pairs)``: the size of the multiset intersection of the keys."""
    a, b = left.groupBy(on).agg(F.count("*").alias("l")), right.groupBy(on).agg(F.count("*").alias("r"))
    return a.join(b, on).agg(F.coalesce(F.sum(F.least("l", "r")), F.lit(0)).cast("long").alias("pairs"))


def equal_expr(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Equality within a tolerance."""
    return F.abs(a - b) < tolerance
