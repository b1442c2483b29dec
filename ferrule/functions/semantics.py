"""Expressions whose meaning differs from plain Spark: division, remainder, strings, doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case- and accent-insensitive comparison; trailing spaces count.
COLLATION = "UNICODE_CI_AI"


def divide(a: Column, b: Column, scale: int, precision: int = 38) -> Column:
    """a / b as an exact decimal of four digits more than the dividend's ``scale``; by zero it is null.

    Spark cuts the scale of wide quotients, so operands are brought to 25 digits first; one that does not fit raises.
    """
    x = a.cast(f"decimal(25,{scale})")
    return F.try_divide(x, b).cast(f"decimal({precision},{scale + 4})")


def remainder(a: Column, b: Column) -> Column:
    """a % b with the sign of a; by zero it is null."""
    return F.try_mod(a, b)


def average(total: Column, count: Column, scale: int) -> Column:
    """An average from a sum and a count, four digits beyond the scale of the summed values."""
    return divide(total, count.cast("decimal(20,0)"), scale)


def finite(c: Column) -> Column:
    """A double that raises when it has overflown."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("DOUBLE value is out of range"))).otherwise(c)


def ascii_byte(c: Column) -> Column:
    """The first byte of a string as a number; 0 for the empty string, null for null."""
    first = F.hex(F.substring(F.encode(c, "UTF-8"), 1, 1))
    return F.when(c.isNotNull(), F.coalesce(F.conv(F.nullif(first, F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long")))


def moment(c: Column) -> Column:
    """Dates and strings are compared as date-times, never as dates."""
    return c.cast("timestamp_ntz")


def ai_ci(c: Column) -> Column:
    """A string under the case- and accent-insensitive collation: in =, IN, GROUP BY, ORDER BY, DISTINCT, MIN, MAX."""
    return F.collate(c, COLLATION)


def like_pattern(pattern: str, escape: str = "\\") -> str:
    """A pattern in Spark's stricter form: any character after the escape is literal, a last escape stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            c = pattern[i] if i < len(pattern) else escape
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return "".join(out)


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    """Byte-wise LIKE."""
    return c.like(like_pattern(pattern, escape))


def plain(c: Column) -> Column:
    """Letters without case and accents: decomposed, marks dropped, lower case.

    JVM-side; it folds what the collation folds for letters of Latin, Greek and Cyrillic with precomposed accents.
    """
    folded = F.translate(c, _ACCENTED, _BARE)
    return F.lower(F.regexp_replace(folded, r"\p{Mn}", ""))


def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x500):
        bare = unicodedata.normalize("NFD", chr(code))
        if len(bare) > 1 and all(unicodedata.combining(x) for x in bare[1:]):
            pairs.append((chr(code), bare[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _BARE = _folding()


def like_ai_ci(c: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE under the insensitive collation: ``_`` is one character, wildcards as usual."""
    p = plain(F.lit(like_pattern(pattern, escape)))
    return F.call_function("like", plain(c), p)

