"""String column helpers (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdlens.fixed_values import PY_WHITESPACE


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: remove every Unicode whitespace char at both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def blank_to_null(c: str | Column) -> Column:
    """'' -> null; other values unchanged."""
    c = col_(c)
    return F.when(c != F.lit(""), c)


def null_or_nan_text_to_empty(c: str | Column) -> Column:
    """Display normalisation: null or the text 'nan' (any case) -> ''."""
    s = col_(c).cast("string")
    return F.when(s.isNull() | (F.lower(s) == F.lit("nan")), F.lit("")).otherwise(s)


def first_non_blank(*cols: str | Column, default: str = "") -> Column:
    """First value that is neither null nor '' (Python ``a or b or default``)."""
    return F.coalesce(*[blank_to_null(col_(c).cast("string")) for c in cols], F.lit(default))


def join_pair(first: str | Column, second: str | Column, sep: str = ", ") -> Column:
    """``"{a}, {b}"`` when b is non-blank, else ``a`` (nulls as '')."""
    a = F.coalesce(col_(first).cast("string"), F.lit(""))
    b = F.coalesce(col_(second).cast("string"), F.lit(""))
    return F.when(b != F.lit(""), F.concat(a, F.lit(sep), b)).otherwise(a)


def symptom_text(c: str | Column) -> Column:
    """Request-side symptom: lowercased and stripped; null -> ''."""
    return F.coalesce(F.lower(py_strip(col_(c))), F.lit(""))
