"""Cleaning and imputation (C1-C7) and the model feature frames.

All operators are column expressions; the only aggregations are the medians,
found together for all columns and inlined as literals, so applying them needs
no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.bp import bp_int_pair_ok, bp_int_part, bp_value, systolic_for_training
from herdlens.functions.numbers import to_double, to_long, trunc_to_long
from herdlens.functions.text import null_or_nan_text_to_empty
from herdlens.operators import sketches
from herdlens.sources.tables import stored

#: Distinct (column, value) pairs up to which one window per column sums up the counts.
SMALL_PAIRS = 1_000_000


def blank_normalise(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null or text 'nan' (any case) -> '' ; every value becomes text."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumns({c: null_or_nan_text_to_empty(c) for c in cols})


def null_to_empty(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Write-side normalisation: missing -> '' (the text 'nan' is kept)."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols})


def numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double, anything that ``float`` would reject -> null."""
    return df.withColumns({c: to_double(c) for c in cols})


def constant_fill(df: DataFrame, numeric: Sequence[str] = (), text: Sequence[str] = (),
                  numeric_value: float = 0.0, text_value: str = "None") -> DataFrame:
    """Numeric nulls -> 0, text nulls -> 'None'."""
    fills = {c: F.coalesce(F.col(c), F.lit(numeric_value)) for c in numeric}
    fills.update({c: F.coalesce(F.col(c), F.lit(text_value)) for c in text})
    return df.withColumns(fills)


def medians_of(df: DataFrame, cols: Sequence[str], strategy: str = "exact",
               accuracy: int = 100_000) -> dict[str, float | None]:
    """Median of each numeric column, nulls and NaN left out; null where nothing is left.

    ``exact``: one pass counts the distinct (column, value) pairs and stores
    them. Up to ``SMALL_PAIRS`` of them are summed up by one window per column.
    More are range-partitioned and stored in order: partition sums (as many
    rows as partitions) tell which partition holds the middle, and only that
    one is summed up, so no task sees a column's whole set of values.
    ``approx``: ``percentile_approx`` in one pass. ``sketch``: a mergeable
    quantile sketch in one pass (see ``sketches``).
    """
    if strategy == "approx":
        row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: None if row[c] is None else float(row[c]) for c in cols}
    if strategy == "sketch":
        return sketches.medians(sketches.sketched(df, cols), cols)
    if strategy != "exact":
        raise ValueError(strategy)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    counted = stored(df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))
                     .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")), "median-counts")
    if counted.count() <= SMALL_PAIRS:
        total = F.sum("n").over(Window.partitionBy("name"))
        found = counted.withColumns({"upto": F.sum("n").over(Window.partitionBy("name").orderBy("v")),
                                     "low": F.floor((total - 1) / 2), "high": F.floor(total / 2)})
    else:
        found = _middle_partitions(counted, cols)

    def holds(rank: str) -> Column:
        return (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("n"))

    rows = (found.where(holds("low") | holds("high")).groupBy("name")
            .agg(((F.min("v") + F.max("v")) / 2).alias("median")).collect())
    return dict.fromkeys(cols) | {r["name"]: r["median"] for r in rows}


def _middle_partitions(counted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``counted`` (name, v, n) near each column's middle, with the rows up to each and both middle ranks."""
    t = stored(counted.repartitionByRange("name", "v").sortWithinPartitions("name", "v")
               .withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "medians")
    parts = t.groupBy("name", "part").agg(F.sum("n").alias("n")).orderBy("name", "part").collect()
    wanted = []  # (column, partition, rows before it, first and second middle rank)
    for c in cols:
        total, before = sum(p["n"] for p in parts if p["name"] == c), 0
        middle = ((total - 1) // 2, total // 2)
        for p in (p for p in parts if p["name"] == c):
            if any(before <= r < before + p["n"] for r in middle):
                wanted.append((c, p["part"], before, *middle))
            before += p["n"]
    at = counted.sparkSession.createDataFrame(wanted, "name string, part long, before long, low long, high long")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("name", "part").orderBy("v"))
    return t.join(F.broadcast(at), ["name", "part"]).withColumn("upto", upto)


def median_impute(df: DataFrame, cols: Sequence[str], strategy: str = "exact",
                  source: DataFrame | None = None) -> DataFrame:
    """C4: fill nulls of each column with the column's median (of ``source``)."""
    medians = medians_of(source if source is not None else df, cols, strategy)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double")) for c in cols})


def bp_split(df: DataFrame, bp: str = "bp", out=("bp_systolic", "bp_diastolic")) -> DataFrame:
    """``sys/dia`` -> two doubles (bad/absent part -> null; extra parts ignored)."""
    return df.withColumns({out[0]: bp_value(bp, 1), out[1]: bp_value(bp, 2)})


def bp_systolic_num(df: DataFrame, bp: str = "bp", out: str = "bp_num", on_error: str = "zero") -> DataFrame:
    """Training-time systolic (parse error -> 0.0, missing -> null).

    C6b: with ``on_error="fail"`` a value that does not parse stops the query.
    """
    if on_error == "zero":
        return df.withColumn(out, systolic_for_training(bp))
    if on_error != "fail":
        raise ValueError(on_error)
    value = bp_value(bp, 1)
    wrong = F.concat(F.lit("could not convert to a number: "), F.col(bp).cast("string"))
    bad = F.col(bp).isNotNull() & value.isNull()
    return df.withColumn(out, F.when(bad, F.raise_error(wrong).cast("double")).otherwise(value))


# ---------------------------------------------------------------------------
# Feature frames
# ---------------------------------------------------------------------------

NUMERIC_FEATURES = FV.NUMERIC_FEATURES
CATEGORICAL_FEATURES = FV.CATEGORICAL_FEATURES


def outcome_label(df: DataFrame, disease: str = "disease", out: str = "outcome",
                  fatal: Sequence[str] = FV.FATAL_DISEASES) -> DataFrame:
    """Fatal disease -> 'Will Not Live', anything else (null too) -> 'Will Live'."""
    d = F.col(disease)
    return df.withColumn(out, F.when(d.isin(*fatal), F.lit(FV.OUTCOME_FATAL))
                         .otherwise(F.lit(FV.OUTCOME_LIVE)))


def model_features(records: DataFrame, bp_fill: str = "zero") -> DataFrame:
    """Training frame of the survival / disease models.

    Outcome from disease; symptoms null -> 'None'; BP split and coerced,
    filled with 0 (``bp_fill="zero"``, default behaviour) or with the
    medians (``"median"``); heart rate coerced and median-filled.
    """
    df = outcome_label(records)
    df = constant_fill(df, text=["symptom_1", "symptom_2"])
    df = bp_split(df)
    df = df.withColumn("heart_rate", to_double("heart_rate"))
    if bp_fill == "zero":
        df = constant_fill(df, numeric=["bp_systolic", "bp_diastolic"])
    elif bp_fill == "median":
        df = median_impute(df, ["bp_systolic", "bp_diastolic"])
    else:
        raise ValueError(bp_fill)
    df = median_impute(df, ["heart_rate"])
    return df


def health_features(records: DataFrame) -> DataFrame:
    """Training frame of the health-status model: systolic, heart rate, age."""
    return (records
            .withColumn("bp_num", systolic_for_training("bp"))
            .withColumn("heart_rate_num", F.coalesce(to_double("heart_rate"), F.lit(0.0)))
            .withColumn("age_num", F.coalesce(to_double("age_years"), F.lit(0.0)))
            .withColumn("label_text", F.coalesce(F.col("health_status").cast("string"),
                                                 F.lit("nan"))))


def intake_impute(intake: DataFrame, training: DataFrame, bp: str = "bp",
                  heart_rate: str = "heart_rate") -> DataFrame:
    """Request-time vitals as integers with median fallbacks.

    Heart rate: ``int(text)`` or int(median). BP: exactly two integers split
    by ``/``, otherwise **both** parts fall back to int(median). Medians come
    from the training frame and are truncated toward zero.
    """
    medians = medians_of(training, FV.NUMERIC_FEATURES)
    hr_med, sys_med, dia_med = (trunc_to_long(F.lit(medians[c]).cast("double")) for c in FV.NUMERIC_FEATURES)
    ok = bp_int_pair_ok(F.col(bp))
    return intake.withColumns({
        "heart_rate_in": F.coalesce(to_long(heart_rate), hr_med),
        "bp_systolic_in": F.when(ok, bp_int_part(bp, 1)).otherwise(sys_med),
        "bp_diastolic_in": F.when(ok, bp_int_part(bp, 2)).otherwise(dia_med),
    })
