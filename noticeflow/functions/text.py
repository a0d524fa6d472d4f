"""Text normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, NumericType

# Python's str.strip() removes every whitespace character, Spark's trim
# only spaces by default: trim the same set explicitly. No regex is evaluated
# per row. The characters that Python counts as whitespace.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def as_number(c: Column) -> Column:
    """Numeric text as a double, else null. The cast alone would also take
    Java's type suffixes (``'45d'``, ``'3F'``)."""
    t = strip_ws(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def upper_strip(c: Column) -> Column:
    return F.upper(strip_ws(c))


def as_text(c: Column, dtype: DataType | None = None) -> Column:
    """Numeric ids to text without scientific notation.

    ``cast(45200000.0D as string)`` gives ``'4.52E7'``; going through
    ``decimal(38,0)`` gives ``'45200000'`` (fractional ids are kept via
    the plain double text, which then keeps its ``.x`` part).
    """
    if isinstance(dtype, (DoubleType, FloatType, DecimalType)):
        return F.when(c == F.floor(c), c.cast(DecimalType(38, 0)).cast("string")) \
                .otherwise(c.cast("string"))
    return c.cast("string")


def id_key(c: Column, dtype: DataType) -> Column:
    """Raw id as join key: exact text for text, and for numeric types the one
    text that equal numbers share (``45200000.0`` and ``45200000``)."""
    return as_text(c, dtype) if isinstance(dtype, NumericType) else c.cast("string")


def normalize_id(c: Column, dtype: DataType | None = None) -> Column:
    """Id normaliser: text, strip, upper, drop one trailing ``.0``."""
    return F.regexp_replace(upper_strip(as_text(c, dtype)), r"\.0$", "")


def null_tokens(c: Column, tokens=("NAN", "NONE")) -> Column:
    """Upper-cased, stripped text with the given tokens turned into null."""
    u = upper_strip(c)
    return F.when(u.isin(*tokens), F.lit(None).cast("string")).otherwise(u)
