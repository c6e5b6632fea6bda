"""Text column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and invisible characters (fixed values).
INVISIBLE = "\\s\\u00a0\\u00ad\\u061c\\u180e\\u1680\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff\\p{Cc}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often a lambda in it asks for it."""
    return F.transform(F.array(value), body)[0]


#: The same characters one by one, for trimming.
BLANKS = "".join(chr(i) for a, z in ((0x00, 0x20), (0x7F, 0xA0), (0xAD, 0xAD), (0x61C, 0x61C), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)) for i in range(a, z + 1))


def strip_blanks(c: Column) -> Column:
    """Without white space and invisible characters at either end: only the ends are looked at."""
    return F.trim(c, F.lit(BLANKS))


def without_blanks(c: Column) -> Column:
    """Without any white space or invisible character."""
    return F.regexp_replace(c, f"[{INVISIBLE}]+", "")


def truthy(c: Column) -> Column:
    """Text booleans of any spelling: true, null and all else are told apart by the caller."""
    return F.lower(strip_blanks(c.cast("string"))).isin("true", "1", "1.0", "yes", "t")


#: A decimal number, with or without sign, fraction or exponent.
DECIMAL = "^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$"


def decimal(c: Column) -> Column:
    """The number that a text writes, null for anything else (also nan and inf)."""
    t = strip_blanks(c)
    x = F.when(t.rlike(DECIMAL), t.try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)
