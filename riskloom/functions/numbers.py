"""Column functions on numbers and their renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = 134217729.0  # 2**27 + 1
_LEAST = 5e-324  # the smallest positive double


# A sign, decimal digits with an optional exponent, or infinity; no type suffixes.
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def number_of(text: Column) -> Column:
    """A text as double; null for what is no number, NaN included."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the column can hold one."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def clamp01(c: Column) -> Column:
    """Limit to [0, 1]; null stays null (``greatest``/``least`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    return high, x - high


def _product_error(x: Column, digits: int, product: Column) -> Column:
    """``x * 10**digits - product`` without rounding (Dekker's product)."""
    high, low = _halves(x)
    scale = 10 ** digits
    if scale < 2 ** 26:
        return (high * F.lit(float(scale)) - product) + low * F.lit(float(scale))
    s_high = float(scale >> 26 << 26)
    s_low = float(scale) - s_high
    return (((high * F.lit(s_high) - product) + high * F.lit(s_low)) + low * F.lit(s_high)) + low * F.lit(s_low)


def nearest_units(c: Column, digits: int) -> Column:
    """``abs(c)`` in units of ``10**-digits``, rounded to nearest with ties to even.

    Decides on the binary value of the double, not on its shortest decimal text: 2.675 is
    below the tie and 0.125 is on it. The product with ``10**digits`` is taken as a double
    plus its rounding error, so a product that merely rounds to a tie is told from a true
    one. Holds for up to ten digits and results below 2**53.

    The argument occurs many times in the expression: give a plain column where it is costly.
    """
    x = F.abs(c)
    product = x * F.lit(float(10 ** digits))
    whole = F.floor(product)
    part = product - whole
    enough = F.when(whole % 2 == 1, 0.0).otherwise(_LEAST)
    up = F.when(part == 0.5, _product_error(x, digits, product) >= enough).otherwise(part > 0.5)
    return whole + up.cast("bigint")


def round_even(c: Column, digits: int) -> Column:
    """The double nearest to ``c`` with the given number of decimals, ties to even."""
    sign = F.when(c < 0, -1.0).otherwise(1.0)
    return sign * (nearest_units(c, digits) / F.lit(float(10 ** digits)))


def _units_text(units: Column, digits: int) -> Column:
    if digits == 0:
        return units.cast("string")
    base = F.lit(10 ** digits)
    return F.concat(
        F.floor(units / base).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((units % base).cast("string"), digits, "0"),
    )


def fixed_digits(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, _units_text(nearest_units(c, digits), digits))


def percent_text(c: Column, digits: int) -> Column:
    """A share as percent text: 0.125 gives ``12%`` with no digits."""
    return F.concat(fixed_digits(c * F.lit(100.0), digits), F.lit("%"))


def short_text(c: Column, digits: int = 4) -> Column:
    """Rounded number with trailing zeros removed but at least one decimal (``0.5``, ``1.0``)."""
    return F.regexp_replace(fixed_digits(c, digits), r"(\.\d+?)0+$", "$1")


def hash_number(text: Column) -> Column:
    """The first 32 bits of the md5 of a text as bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from the md5 of the parts joined by ``:``."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return hash_number(text) / F.lit(4294967296.0)


def at_most_counts(c: Column, bounds: Sequence[float]) -> list[Column]:
    """One conditional count per upper bound plus the total: a cumulative histogram in one pass."""
    return [F.count_if(c <= F.lit(b)) for b in bounds] + [F.count(c)]


def exact_sum(c: Column) -> Column:
    """Sum of amounts as decimals of 18 places, whatever the order of adding.

    Tasks that finish in another order or run again change nothing. Finer than any rate card:
    a price per token of ten places times a token count needs ten.
    """
    return F.sum(c.cast("decimal(28,18)")).cast("double")
