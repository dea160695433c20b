"""Scalar functions on columns, all of built-in expressions: nothing here leaves generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- arithmetic with defined results for zero divisors


def safe_div(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(0.0))


def safe_mod(a, b) -> Column:
    return F.coalesce(F.try_mod(col(a), col(b)), F.lit(0))


def vec_div(a, b) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(col(b) == 0, F.lit(NAN)).otherwise(F.try_divide(col(a), col(b)))


def div_trunc(a: str, b: str) -> Column:
    """Integer quotient towards zero; raises for a zero divisor."""
    return F.expr(f"{a} div {b}")


def floor_div(a, b) -> Column:
    """Quotient rounded down, 0 for a zero divisor."""
    return F.coalesce(F.floor(F.try_divide(col(a), col(b))), F.lit(0))


def ceil_div(a, b) -> Column:
    return F.coalesce(F.ceil(F.try_divide(col(a), col(b))), F.lit(0))


def avg2(a, b) -> Column:
    """Mean of two integers without overflow, rounded as their halves are."""
    x, y = col(a), col(b)
    return F.shiftright(x, 1) + F.shiftright(y, 1) + F.floor((x.bitwiseAND(F.lit(1)) + y.bitwiseAND(F.lit(1))) / 2)


def fma(a, b, c) -> Column:
    return col(a) * col(b) + col(c)


def fms(a, b, c) -> Column:
    return col(a) * col(b) - col(c)


def reciprocal(a) -> Column:
    return F.try_divide(F.lit(1.0), col(a))


def rsqrt(a) -> Column:
    return F.try_divide(F.lit(1.0), F.sqrt(col(a)))


def fast_sqrt(a) -> Column:
    """Square root, 0 for values that have none."""
    return F.when(col(a) <= 0, 0.0).otherwise(F.sqrt(F.greatest(col(a), F.lit(0.0))))


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * t


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def vec_min(a, b) -> Column:
    """Smaller of two doubles; NaN if either is."""
    x, y = col(a), col(b)
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.least(x, y))


def vec_max(a, b) -> Column:
    """Larger of two doubles; a NaN on one side is passed over."""
    x, y = col(a), col(b)
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def is_finite(x) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) != float("inf"))


def sentinel_null(x, sentinel) -> Column:
    """Null for a sentinel value and for NaN."""
    c = col(x)
    return F.when((c == F.lit(sentinel)) | F.isnan(c.cast("double")), F.lit(None)).otherwise(c)


# ---- bits of 64-bit integers


def rotate_left(x, n: int) -> Column:
    n &= 63
    return col(x) if n == 0 else F.shiftleft(col(x), n).bitwiseOR(F.shiftrightunsigned(col(x), 64 - n))


def rotate_right(x, n: int) -> Column:
    return rotate_left(x, 64 - (n & 63))


def leading_zeros(x) -> Column:
    return F.when(col(x) == 0, 64).otherwise(64 - F.length(F.bin(col(x))))


def trailing_zeros(x) -> Column:
    """64 for 0.  Counted on the binary digits, as negation overflows at the least integer."""
    digits = F.bin(col(x))
    return F.when(col(x) == 0, 64).otherwise(F.length(digits) - F.length(F.rtrim(F.translate(digits, "0", " "))))


def bit_field(x, start: int, length: int) -> Column:
    return F.shiftrightunsigned(col(x), start).bitwiseAND(F.lit((1 << length) - 1 if length < 63 else 0x7FFFFFFFFFFFFFFF))


def zero_high(x, n: int) -> Column:
    """Bits from ``n`` on cleared; 63 and more keep all."""
    return col(x) if n >= 63 else col(x).bitwiseAND(F.lit((1 << n) - 1))


def bit_reverse(x) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(col(x)), 64, "0")), 2, -10).cast("long")


def byte_swap(x) -> Column:
    h = F.lpad(F.hex(col(x)), 16, "0")
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long")


def is_power_of_two(x) -> Column:
    return (col(x) > 0) & (F.bit_count(col(x)) == 1)


def next_power_of_two(x) -> Column:
    """The least power of two no smaller than a positive integer."""
    c = col(x)
    return F.when(c <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(c - 1))).cast("long"))


def log2_floor(x) -> Column:
    return F.when(col(x) > 0, F.length(F.bin(col(x))) - 1)


def log2_ceil(x) -> Column:
    return F.when(col(x) > 1, F.length(F.bin(col(x) - 1))).when(col(x) == 1, 0)


def align_up(x, n: int) -> Column:
    return F.ceil(col(x) / n).cast("long") * n


def align_down(x, n: int) -> Column:
    return F.floor(col(x) / n).cast("long") * n


def unsigned_less(a, b) -> Column:
    """a < b as unsigned 64-bit numbers."""
    flip = F.lit(-(2**63)).cast("long")
    return col(a).bitwiseXOR(flip) < col(b).bitwiseXOR(flip)


def any_bits(a, b) -> Column:
    return col(a).bitwiseAND(col(b)) != 0


# ---- conversion


def wrap_signed(x, bits: int) -> Column:
    """The low ``bits`` bits as a signed integer."""
    low = col(x).bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)


def wrap_unsigned(x, bits: int) -> Column:
    return col(x).bitwiseAND(F.lit((1 << bits) - 1))


def fits(x, kind: str) -> Column:
    """Whether a value has the type's range."""
    return col(x).isNull() | col(x).try_cast(kind).isNotNull()


def three_way(a, b) -> Column:
    """0 equal, 1 less, 255 else."""
    return F.when(col(a) == col(b), 0).when(col(a) < col(b), 1).otherwise(255)


def missing(x) -> Column:
    """Null or NaN."""
    return col(x).isNull() | F.isnan(col(x))


def present(x) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x))


# ---- arrays as lanes


def lanes_even(a) -> Column:
    return F.filter(col(a), lambda x, i: i % 2 == 0)


def lanes_odd(a) -> Column:
    return F.filter(col(a), lambda x, i: i % 2 == 1)


def lane(a, i: int, missing=0.0) -> Column:
    return F.coalesce(F.get(col(a), F.lit(i)), F.lit(missing))


def lane_set(a, i: int, value) -> Column:
    return F.transform(col(a), lambda x, k: F.when(k == i, F.lit(value)).otherwise(x))


def permute(a, positions) -> Column:
    return F.transform(col(positions), lambda i: F.get(col(a), i))


def rotate_lanes(a, n: int) -> Column:
    """The first ``n`` lanes moved to the end."""
    return F.concat(F.slice(col(a), n + 1, F.size(col(a)) - n), F.slice(col(a), 1, n))


def slide_lanes(a, n: int, fill: float = 0.0) -> Column:
    """Lanes moved left by ``n``; the end is filled."""
    return F.concat(F.slice(col(a), n + 1, F.size(col(a)) - n), F.array_repeat(F.lit(fill), n))
