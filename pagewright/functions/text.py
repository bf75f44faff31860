"""What all text functions share: white space, digits and line ends of any script, and values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and as digits (for use within brackets), line ends, full-width forms.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGIT = r"\p{Nd}"
LINE_END = r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SPACES = (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WIDE, NARROW = "０１２３４５６７８９，．", "0123456789,."


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(text: Column) -> Column:
    return F.split(given(text), LINE_END)


def narrow(text: Column) -> Column:
    """With full-width digits, commas and stops as half-width ones."""
    return F.translate(text, WIDE, NARROW)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(given(text), F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often and within whatever lambda the body names it."""
    return F.transform(F.array(value), body)[0]


def rounded(x: Column, places: int) -> Column:
    """A double rounded to some places (up to 6), as its exact binary value says; half to even.

    The product with a power of ten and its rounding error are taken together, so that 2.675, which lies below that, gives
    2.67.  Sizes from 10^9 on are returned as they are, for want of digits behind those places.
    """
    ten = 10.0**places

    def parts(x: Column) -> Column:
        # the upper 26 bits of x, then the error of the product
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        product = x * F.lit(ten)
        return F.struct(x.alias("x"), product.alias("p"), ((high * F.lit(ten) - product) + (x - high) * F.lit(ten)).alias("e"), F.floor(product).cast("double").alias("f"))

    def close(v: Column) -> Column:
        over = (v["p"] - v["f"] - F.lit(0.5)) + v["e"]
        up = F.when(over > 0, F.lit(1.0)).when(over < 0, F.lit(0.0)).otherwise(F.pmod(v["f"], F.lit(2.0)))
        return F.when(F.abs(v["x"]) >= 1e9, v["x"]).otherwise((v["f"] + up) / F.lit(ten))

    return let(let(x, parts), close)
