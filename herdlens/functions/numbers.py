"""Guarded numeric parsing.

Spark's ``try_cast`` accepts more than Python's ``float``/``int`` (for example
``'12d'`` becomes 12.0), so every parse is guarded by the Python grammar first
and only then cast. Everything stays a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdlens.fixed_values import FLOAT_PATTERN, INT_PATTERN
from herdlens.functions.text import col_


def is_float_text(c: str | Column) -> Column:
    return col_(c).cast("string").rlike(FLOAT_PATTERN)


def is_int_text(c: str | Column) -> Column:
    return col_(c).cast("string").rlike(INT_PATTERN)


def to_double(c: str | Column) -> Column:
    """Like ``pd.to_numeric(errors='coerce')`` on text: bad or null -> null."""
    s = col_(c).cast("string")
    return F.when(is_float_text(s), F.trim(s).try_cast("double"))


def to_long(c: str | Column) -> Column:
    """Like ``int(s)`` on text: bad or null -> null."""
    s = col_(c).cast("string")
    return F.when(is_int_text(s), F.trim(s).try_cast("bigint"))


def trunc_to_long(c: str | Column) -> Column:
    """``int(x)`` of a float: truncate toward zero."""
    x = col_(c)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")

