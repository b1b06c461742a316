"""Blood-pressure text ``"sys/dia"`` helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdlens.functions.numbers import is_float_text, is_int_text, to_double, to_long
from herdlens.functions.text import col_


def bp_part(c: str | Column, part: int) -> Column:
    """Text of part ``part`` (1-based) of a ``/``-separated value; '' when absent.

    ``split_part`` never raises on short inputs (``split(...)[i]`` does under ANSI).
    """
    return F.split_part(col_(c).cast("string"), F.lit("/"), F.lit(part))


def bp_value(c: str | Column, part: int) -> Column:
    """Coerced numeric part: bad, absent or null -> null. Extra parts are ignored."""
    return to_double(bp_part(c, part))


def systolic_for_training(c: str | Column) -> Column:
    """Text before the first ``/`` as float; unparsable -> 0.0; missing -> null.

    A missing value stays missing (it reads back as NaN text, which parses as
    NaN), which is kept apart from the 0.0 of a parse error.
    """
    s = col_(c).cast("string")
    head = bp_part(s, 1)
    return (F.when(s.isNull(), F.lit(None).cast("double"))
            .when(is_float_text(head), to_double(head))
            .otherwise(F.lit(0.0)))


def bp_int_pair_ok(c: str | Column) -> Column:
    """True when the text is exactly two integers separated by one ``/``."""
    s = col_(c).cast("string")
    return (F.size(F.split(s, "/")) == 2) & is_int_text(bp_part(s, 1)) & is_int_text(bp_part(s, 2))


def bp_int_part(c: str | Column, part: int) -> Column:
    return to_long(bp_part(c, part))


__all__ = ["bp_part", "bp_value", "systolic_for_training", "bp_int_pair_ok", "bp_int_part",
           "is_float_text"]
