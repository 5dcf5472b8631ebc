"""Exact numbers with four decimals: a BIGINT scaled by 10,000.

Sums run in DECIMAL(38,0) and are cast back with a check; products and quotients round half
to even.  ``checked`` columns hold NULL where a result leaves the BIGINT range.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CubeError

SCALE = 10_000
LOWEST, HIGHEST = -(2**63), 2**63 - 1
_TEXT = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?")
WIDE = "decimal(38,0)"


def parse(text: str) -> int:
    """The scaled integer of a decimal text: optional sign, at most four decimals, no exponent."""
    bare = text.strip()
    m = _TEXT.fullmatch(bare)
    if not bare or not m or not (m[2] or "." in bare):
        raise CubeError(f"not a number: {text!r}")
    decimals = m[3] or ""
    if len(decimals) > 4:
        raise CubeError(f"more than four decimals: {text!r}")
    value = int(m[2] or 0) * SCALE + int(decimals.ljust(4, "0"))
    value = -value if m[1] == "-" else value
    if not LOWEST <= value <= HIGHEST:
        raise CubeError(f"out of range: {text!r}")
    return value


def format(value: int) -> str:  # noqa: A001
    """The canonical text: no trailing zeros, no empty fraction."""
    whole, part = divmod(abs(value), SCALE)
    text = f"{whole}.{part:04d}".rstrip("0").rstrip(".")
    return f"-{text}" if value < 0 else text


def scaled(amount: Column) -> Column:
    """The scaled BIGINT of a double that holds at most four decimals."""
    return F.round(amount * SCALE).cast("bigint")


def parsed(text: Column) -> Column:
    """``parse`` as a column; NULL for texts it refuses."""
    bare = F.trim(text)
    fits = bare.rlike(r"^[+-]?([0-9]+(\.[0-9]{0,4})?|\.[0-9]{0,4})$")
    plain = F.when(bare.rlike(r"^[+-]?\.?$"), F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(bare, r"\.$", ""), r"^([+-]?)\.", "$10."))
    return F.when(fits, (plain.try_cast("decimal(38,4)") * SCALE).try_cast("bigint"))


def formatted(value: Column) -> Column:
    """``format`` as a column."""
    text = (value.cast("decimal(38,4)") / SCALE).cast("decimal(38,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def total(v: Column) -> Column:
    """An exact sum as DECIMAL(38,0); intermediate sums can't overflow."""
    return F.sum(v.cast(WIDE)).cast(WIDE)


def fits(wide: Column) -> Column:
    """Whether a wide value is within the BIGINT range."""
    return wide.between(F.lit(str(LOWEST)).cast(WIDE), F.lit(str(HIGHEST)).cast(WIDE))


def narrowed(wide: Column) -> Column:
    """A wide value as BIGINT; NULL out of range."""
    return F.when(fits(wide), wide.cast("bigint"))


def _same(x: Column) -> Column:
    return x


def divided(num: Column, den: Column, let: Callable[[Column], Column] = _same) -> Column:
    """num / den of wide integers, half to even, as BIGINT; NULL if den is 0 or the result is out of range.

    DECIMAL division by ``div`` returns a BIGINT that wraps, so the range is tested first.  Values
    named more than once go through ``let``, which may make them columns of their own: spelled
    out, the expression grows too long for generated code.
    """
    num, den = let(num.cast(WIDE)), let(den.cast(WIDE))
    safe = let((den != 0) & (F.abs(num) / F.greatest(F.abs(den), F.lit(1).cast(WIDE)) < F.lit(str(HIGHEST)).cast(WIDE)))
    d = let(F.when(safe, den).otherwise(F.lit(1).cast(WIDE)))
    n = let(F.when(safe, num).otherwise(F.lit(0).cast(WIDE)))
    q = let(F.call_function("div", n, d).cast("bigint"))
    r = let((n - q.cast(WIDE) * d).cast(WIDE))
    twice, size = F.abs(r) * 2, F.abs(d)
    up = (twice > size) | ((twice == size) & (q % 2 != 0))
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    return F.when(safe, q + F.when(up, sign).otherwise(F.lit(0)))


def product(a: Column, b: Column, let: Callable[[Column], Column] = _same) -> Column:
    """a * b of scaled values, half to even; NULL out of range."""
    return divided(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), F.lit(SCALE), let)


def quotient(a: Column, b: Column, let: Callable[[Column], Column] = _same) -> Column:
    """a / b of scaled values, half to even; NULL if b is 0 or out of range."""
    return divided(a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(5,0)"), b, let)


def div_half_even(num: int, den: int) -> int:
    """The same division of Python integers."""
    q, r = divmod(abs(num), abs(den))
    if 2 * r > abs(den) or (2 * r == abs(den) and q % 2):
        q += 1
    return -q if (num < 0) != (den < 0) else q
