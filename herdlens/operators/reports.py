"""Per-animal reports (RP1-RP3) for the whole table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.text import first_non_blank, join_pair, null_or_nan_text_to_empty
from herdlens.operators.filters import alias_value


def _text(df: DataFrame, c: str, absent: str = "") -> Column:
    return null_or_nan_text_to_empty(c) if c in df.columns else F.lit(absent)


def detected_disease(df: DataFrame, request_col: str | None = None, chain: str = "full") -> Column:
    """RP2: first non-blank of the request value, 'detected_disease' and 'disease'.

    ``chain="detected"`` is the variant that looks at 'detected_disease' alone.
    """
    names = ["detected_disease"] if chain == "detected" else [request_col, "detected_disease", "disease"]
    present = [c for c in names if c and c in df.columns]
    return first_non_blank(*[null_or_nan_text_to_empty(c) for c in present]) if present else F.lit("")


def animal_report(df: DataFrame, id_col: str = "animal_id", accuracy_pct: float | Column | None = None,
                  request_col: str | None = None, chain: str = "full") -> DataFrame:
    """RP1: 13 ordered (label, text) lines per animal -> (id, line_no, label, text).

    ``accuracy_pct`` is the model accuracy (a number, or a column such as a
    scalar subquery over the model's test rows; blank when not given). A narrow
    ``inline``; no shuffle.
    """
    if accuracy_pct is None:
        acc = F.lit("")
    else:
        number = accuracy_pct if isinstance(accuracy_pct, Column) else F.lit(float(accuracy_pct))
        acc = F.concat(number.cast("double").cast("string"), F.lit("%"))
    texts = [
        _text(df, "name"),
        _text(df, "breed"),
        alias_value(df, FV.AGE_NAMES),
        _text(df, "bp"),
        alias_value(df, FV.HEART_RATE_NAMES),
        alias_value(df, FV.OXYGEN_NAMES),
        join_pair(_text(df, "symptom_1"), _text(df, "symptom_2")),
        detected_disease(df, request_col, chain),
        acc,
        _text(df, "vaccination_1"),
        _text(df, "vaccination_2"),
        _text(df, "doctor_suggestion"),
        _text(df, "special_care"),
    ]
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(label).alias("label"), t.alias("text"))
                      for i, (label, t) in enumerate(zip(FV.REPORT_LABELS, texts), start=1)])
    return df.select(id_col, F.inline(lines))


def record_card(df: DataFrame, id_col: str = "animal_id") -> DataFrame:
    """RP3: display projection (star flag, alias fallbacks, joined symptoms)."""
    star = F.lower(F.coalesce(F.col("special_care"), F.lit(""))) == F.lit("yes") \
        if "special_care" in df.columns else F.lit(False)
    return df.select(
        id_col,
        star.alias("special_star"),
        _text(df, "name").alias("name"),
        _text(df, "breed").alias("breed"),
        alias_value(df, FV.AGE_NAMES, zero_falls_through=True).alias("age"),
        _text(df, "bp").alias("bp"),
        alias_value(df, FV.HEART_RATE_NAMES, zero_falls_through=True).alias("heart_rate"),
        alias_value(df, FV.OXYGEN_NAMES, zero_falls_through=True).alias("oxygen_saturation"),
        join_pair(_text(df, "symptom_1"), _text(df, "symptom_2")).alias("symptoms"),
        _text(df, "vaccination_1", FV.ABSENT_SLOT).alias("vaccination_1"),
        _text(df, "vaccination_2", FV.ABSENT_SLOT).alias("vaccination_2"),
    )
