"""Literal bounds on one column, tightened as they are added.

Catalyst keeps every conjunct of ``x > 10 AND x > 20``; a builder that sees the literals can keep only the one that
counts, which leaves one comparison per row and one pushed filter per side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    low: object = None
    low_strict: bool = False
    high: object = None
    high_strict: bool = False
    excluded: frozenset = frozenset()

    def above(self, t, strict: bool) -> Bounds:
        if self.low is None or t > self.low or (t == self.low and strict):
            return replace(self, low=t, low_strict=strict)
        return self

    def below(self, t, strict: bool) -> Bounds:
        if self.high is None or t < self.high or (t == self.high and strict):
            return replace(self, high=t, high_strict=strict)
        return self

    def without(self, t) -> Bounds:
        return replace(self, excluded=self.excluded | {t})

    def empty(self) -> bool:
        """True if no value can pass."""
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or (self.low == self.high and (self.low_strict or self.high_strict or self.low in self.excluded))

    def condition(self, c: Column, double: bool = True) -> Column | None:
        """The predicate on ``c``, None if all rows pass.  NaN passes no comparison but <>."""
        if self.empty():
            return F.lit(False)
        parts = []
        if self.low is not None and self.low == self.high:
            parts.append(c == F.lit(self.low))
        else:
            if self.low is not None:
                parts.append(c > F.lit(self.low) if self.low_strict else c >= F.lit(self.low))
                if double and self.high is None:
                    parts.append(~F.isnan(c))  # NaN sorts above all numbers in Spark
            if self.high is not None:
                parts.append(c < F.lit(self.high) if self.high_strict else c <= F.lit(self.high))
        parts += [c != F.lit(t) for t in sorted(self.excluded)]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out
