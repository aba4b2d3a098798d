"""The one place where values are given the two types that columns may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

I64, F64 = "I64", "F64"
#: Bits of a limb of a wrapping sum, and the number of rows (or of pairs) up to which its limbs cannot overflow.
LIMB, LIMB_TIMES = 16, 1 << 46
_LOW = (1 << LIMB) - 1


class EngineError(ValueError):
    """A request that the engine rejects."""


def kind_of(data_type: T.DataType) -> str:
    """I64 for whole numbers up to 64 bits; F64 for other numbers; anything else is an error."""
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return I64
    if isinstance(data_type, T.FloatType | T.DoubleType | T.DecimalType):
        return F64
    raise EngineError(f"a value of type {data_type.simpleString()} is not a number")


def normalised(df: DataFrame, column: str | Column) -> tuple[Column, str]:
    """The column as bigint or double, and which."""
    c = F.col(column) if isinstance(column, str) else column
    kind = kind_of(df.select(c).schema[0].dataType)
    return c.cast("bigint" if kind == I64 else "double"), kind


def wrapping_sum(v: Column, times: Column | None = None) -> Column:
    """Sum of times * v modulo 2 ** 64 as a signed bigint; null over no values.

    Four 16-bit limbs are summed apart, so nothing overflows under either ANSI
    setting while the times add up to less than LIMB_TIMES.
    """
    return join_limbs([F.sum(x) for x in _limbs(v, times)])


def wrapping_sum_over(v: Column, window) -> Column:
    return join_limbs([F.sum(x).over(window) for x in _limbs(v, None)])


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64."""
    return join_limbs([x + y for x, y in zip(_limbs(a, None), _limbs(b, None), strict=True)])


def _limbs(v: Column, times: Column | None) -> list[Column]:
    """From the lowest; the highest has the sign."""
    low = [(v if not i else F.shiftright(v, LIMB * i)).bitwiseAND(F.lit(_LOW)) for i in range(3)]
    limbs = [*low, F.shiftright(v, 3 * LIMB)]
    return limbs if times is None else [x * times for x in limbs]


def join_limbs(sums: list[Column]) -> Column:
    """Carries go up; what goes over the highest limb is lost, as it is modulo 2 ** 64."""
    out, carry = None, None
    for i, total in enumerate(sums):
        total = total if carry is None else total + carry
        limb = total.bitwiseAND(F.lit(_LOW))
        out = limb if out is None else out.bitwiseOR(F.shiftleft(limb, LIMB * i))
        carry = F.shiftright(total, LIMB)
    return out


def wrapping_sum_sql(v: str, times: str | None = None, tail: str = "") -> str:
    """The same as SQL text; `tail` is a FILTER or OVER clause."""
    limbs = [f"(shiftright({v}, {LIMB * i}) & {_LOW}L)" if i < 3 else f"shiftright({v}, {LIMB * i})" for i in range(4)]
    sums = [f"sum({x if times is None else f'({times}) * {x}'}){tail}" for x in limbs]
    parts, carry = [], ""
    for i, total in enumerate(sums):
        total = f"({total}{carry})"
        parts.append(f"shiftleft({total} & {_LOW}L, {LIMB * i})")
        carry = f" + shiftright({total}, {LIMB})"
    return f"({' | '.join(parts)})"
