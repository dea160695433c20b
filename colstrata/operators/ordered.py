"""Row order over a whole table without moving it to one task.

A table in a total order is dealt to ranges of about RANGE_ROWS rows.  The cuts between ranges are keys of a sorted
sample, held in one broadcast row and searched by halves, so a row costs some 16 comparisons whatever the number of
ranges.  Ranges are summed where they are; what a range needs from those before it is one row a range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range of a totally ordered table holds, about, and the most ranges that there are: beyond, ranges grow.
RANGE_ROWS, MAX_RANGES = 1 << 18, 1 << 16
#: Sampled keys a range.
SAMPLE = 20


@dataclass(frozen=True)
class Key:
    """A column to order by."""

    name: str
    descending: bool = False
    nulls_last: bool = False

    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def sort(self) -> Column:
        c = self.column()
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def keys(order: Sequence[str | Key]) -> list[Key]:
    return [k if isinstance(k, Key) else Key(k) for k in order]


def spare(df: DataFrame, *names: str, also: Sequence[str] = ()) -> list[str]:
    """Names for working columns that ``df`` doesn't have, nor ``also``."""
    used, out = {c.lower() for c in (*df.columns, *also)}, []
    for n in names:
        while f"__{n}" in used:
            n += "_"
        used.add(f"__{n}")
        out.append(f"__{n}")
    return out


def bisect(size: Column, steps: int, goes_right: Callable[[Column], Column]) -> Column:
    """How many of the first positions, from 1 to ``size``, satisfy ``goes_right``, which holds up to some position and
    not from there on; at most 2 ** steps - 1 positions."""
    start = F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & F.coalesce(goes_right(F.greatest(mid, F.lit(1))), F.lit(False))
        return F.struct(F.when(right, mid).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid - 1).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, halve)["lo"]


def _precedes(cut: Sequence[Column], order: list[Key]) -> Column:
    """Whether the key made of ``cut`` comes before the row's."""
    out = F.lit(False)
    for a, k in reversed(list(zip(cut, order))):
        b = k.column()
        first = (b.isNull() & a.isNotNull()) if k.nulls_last else (a.isNull() & b.isNotNull())
        less = first | F.coalesce((a > b) if k.descending else (a < b), F.lit(False))
        out = less if k is order[-1] else less | (a.eqNullSafe(b) & out)
    return out


class Ranges:
    """``df`` dealt to ranges: column ``part`` of ``df`` counts them in the order.  The table is counted and, if it has
    several ranges, sampled when this is made."""

    def __init__(self, df: DataFrame, order: Sequence[str | Key], rows: int = RANGE_ROWS):
        self.order = keys(order)
        self.sort = [k.sort() for k in self.order]
        (self.part,) = spare(df, "part")
        n = df.count()
        ranges = min(MAX_RANGES, -(-n // rows))
        self.one = ranges < 2
        if self.one:
            self.df = df.withColumn(self.part, F.lit(0))
            return
        narrow = df.select(*[k.column().alias(f"k{i}") for i, k in enumerate(self.order)])
        step = [Key(f"k{i}", k.descending, k.nulls_last).sort() for i, k in enumerate(self.order)]
        sample = narrow.sample(min(1.0, SAMPLE * ranges / n), seed=7).withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*step)))
        cuts = sample.where(F.col("at") % SAMPLE == 0).drop("at").collect()  # a key a range: at most MAX_RANGES
        names = spare(df, *[f"cut{i}" for i in range(len(self.order))])
        kinds = [T.StructField(n, T.ArrayType(f.dataType)) for n, f in zip(names, narrow.schema)]
        table = df.sparkSession.createDataFrame([tuple([c[i] for c in cuts] for i in range(len(names)))], T.StructType(kinds))
        # the number of cuts before the row, bit by bit from the highest

        def raised(low: Column, bit: Column) -> Column:
            at = low + bit
            passed = (at <= len(cuts)) & _precedes([F.get(n, at - 1) for n in names], self.order)
            return F.when(passed, at).otherwise(low)

        bits = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        self.df = df.join(F.broadcast(table)).withColumn(self.part, F.aggregate(bits, F.lit(0), raised)).drop(*names)

    def window(self):
        return Window.partitionBy(self.part).orderBy(*self.sort)

    def _carried(self, df: DataFrame, per: Column, over: Callable[[object], Column]) -> tuple[DataFrame, str]:
        """``df`` with a column of what the ranges before give: ``per`` is an aggregate of a range, ``over`` puts those of the
        ranges before a window together.  One row a range, at most MAX_RANGES."""
        made, carry = spare(df, "made", "carry")
        sums = df.groupBy(self.part).agg(per.alias(made))
        before = over(Window.partitionBy(F.lit(0)).orderBy(self.part), F.col(made))
        offsets = sums.select(self.part, before.alias(carry))
        return df.join(F.broadcast(offsets), self.part), carry

    def running(self, df: DataFrame, value: Column, alias: str, how: str = "sum") -> DataFrame:
        """``df``, rows of these ranges, with the running sum or max of ``value``."""
        agg = {"sum": F.sum, "max": F.max}[how]
        inside = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if self.one:
            return df.withColumn(alias, agg(value).over(inside))
        (v,) = spare(df, "value")
        held, carry = self._carried(df.withColumn(v, value), agg(v), lambda w, c: agg(c).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        own = agg(v).over(inside)
        both = F.coalesce(F.col(carry), F.lit(0)) + own if how == "sum" else F.greatest(F.col(carry), own)
        return held.withColumn(alias, both).drop(v, carry)

    def running_in(self, df: DataFrame, by: Sequence[str], value: Column, alias: str, how: str = "sum") -> DataFrame:
        """``df``, rows of these ranges, with the running sum or max of ``value`` within the columns ``by``, which lead the
        order.  Only a column value that goes on from earlier ranges takes something over: at most one a range."""
        agg = {"sum": F.sum, "max": F.max}[how]
        inside = Window.partitionBy(self.part, *by).orderBy(*self.sort).rowsBetween(Window.unboundedPreceding, 0)
        if self.one:
            return df.withColumn(alias, agg(value).over(inside))
        v, carry = spare(df, "value", "carry")
        held = df.withColumn(v, value)
        per = held.groupBy(self.part, *by).agg(agg(v).alias(carry))
        earlier = Window.partitionBy(*by).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        names = [f"{carry}{i}" for i in range(len(by) + 1)]
        late = per.withColumn(carry, agg(carry).over(earlier)).where(F.col(carry).isNotNull()).select(self.part, *by, carry).toDF(*names, carry)
        joined = held.join(F.broadcast(late), [F.col(a).eqNullSafe(F.col(b)) for a, b in zip((self.part, *by), names)], "left")
        own = agg(v).over(inside)
        both = F.coalesce(F.col(carry), F.lit(0)) + own if how == "sum" else F.greatest(F.col(carry), own)
        return joined.withColumn(alias, both).drop(v, carry, *names)

    def before(self, df: DataFrame, value: Column, alias: str) -> DataFrame:
        """``df`` with ``value`` of the row before, whatever its range; the first row has none."""
        if self.one:
            return df.withColumn(alias, F.lag(value).over(self.window()))
        (v,) = spare(df, "value")
        rows = df.withColumn(v, F.struct(value.alias("v")))
        last = F.max_by(v, F.struct(*[k.column() for k in self.order]))
        if any(k.descending or k.nulls_last for k in self.order):
            raise ValueError("ascending orders only")
        held, carry = self._carried(rows, last, lambda w, c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        own = F.lag(v).over(self.window())
        return held.withColumn(alias, F.coalesce(own, F.col(carry))["v"]).drop(v, carry)

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(self.part)


def running_sum(df: DataFrame, value: Column, order: Sequence[str | Key], alias: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the running sum of ``value`` in the total order ``order``.  No task gets more than a range."""
    r = Ranges(df, order, rows)
    return r.done(r.running(r.df, value, alias))


def row_index(df: DataFrame, order: Sequence[str | Key], alias: str = "row_idx", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with its rows numbered from 0 in the total order ``order``."""
    r = Ranges(df, order, rows)
    return r.done(r.running(r.df, F.lit(1).cast("long"), alias)).withColumn(alias, F.col(alias) - 1)


def blocks(df: DataFrame, index: str, block: str, own: str, before: int, after: int = 0, size: int = 1 << 20) -> DataFrame:
    """Rows with columns ``block`` and ``own``: every block also gets copies (``own`` false) of the ``before`` rows before it
    and the ``after`` rows after it, so that row frames can be taken block by block.  ``size`` must be no less than either."""
    size = max(size, before, after, 1)
    b, at = F.floor(F.col(index) / size), F.col(index) % size
    homes = F.filter(F.array(b, F.when(at >= size - before, b + 1), F.when((at < after) & (b > 0), b - 1)), lambda x: x.isNotNull())
    return df.withColumn(own, b).withColumn(block, F.explode(homes)).withColumn(own, F.col(block) == F.col(own))
