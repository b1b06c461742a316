"""Helpers shared by the operators: stored tables, distributed ranking (from the library), size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.sources.tables import passing_scratch, ranked, scratch_path, ship, stored

__all__ = ["passing_scratch", "ranked", "scratch_path", "ship", "small", "stored", "text_of"]


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint when the counted ``rows`` is within ``max_rows``; a plain join side beyond."""
    return F.broadcast(df) if rows <= max_rows else df


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
