"""Lookups, validation and projections.

Lookups are joins of a request batch against the record table on the key
compared as text. "First match wins" is made explicit: records carry an
input-order column and the first row per key is ``row_number() = 1``, which
Spark limits to one row per key and task before the shuffle. Whether a join
side is broadcast is left to AQE, which decides from measured sizes at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.numbers import is_float_text, to_double
from herdlens.functions.text import first_non_blank, null_or_nan_text_to_empty, py_strip

ORDER_COL = "_input_order"


def with_input_order(df: DataFrame, out: str = ORDER_COL) -> DataFrame:
    """Tag rows with their position in the input (file path, row in file).

    Uses the Parquet ``_metadata`` columns, so the order is deterministic and
    independent of partitioning. Must be applied directly on a file scan.
    """
    return df.withColumn(out, F.struct(F.col("_metadata.file_path").alias("f"),
                                       F.col("_metadata.row_index").alias("r")))


def first_records(records: DataFrame, key: str, order: str = ORDER_COL) -> DataFrame:
    """The first record of each key, without its order column."""
    first = Window.partitionBy(F.col(key).cast("string")).orderBy(order)
    return records.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n", order)


def lookup(requests: DataFrame, request_key: str, records: DataFrame, record_key: str,
           order: str | None = ORDER_COL, how: str = "inner", spread: int = 16) -> DataFrame:
    """Requests joined to the first record whose key text equals the request text.

    Only keys that are asked for are looked up. A key that many requests ask
    for is spread: requests are dealt over ``spread`` parts and the one record
    found per key is there in each part (``spread`` 1: neither is done). A record
    column that shares its name with a request column comes back as ``record_<name>``.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in requests.columns]), F.lit(spread)).cast("int")
    req = requests.withColumns({"_key": F.col(request_key).cast("string"), "_part": part})
    rec = records.withColumn("_key", F.col(record_key).cast("string"))
    if order is not None:
        wanted = req.select("_key").distinct()
        first = Window.partitionBy("_key").orderBy(order)
        rec = (rec.join(wanted, "_key", "left_semi").withColumn("_n", F.row_number().over(first))
               .where(F.col("_n") == 1).drop("_n", order))
    rec = rec.select("_key", *[F.col(c).alias(f"record_{c}" if c in requests.columns else c)
                               for c in rec.columns if c != "_key"])
    if spread == 1:
        return req.drop("_part").join(rec, "_key", how).drop("_key")
    rec = rec.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return req.join(rec, ["_key", "_part"], how).drop("_key", "_part")


def lookup_missing(requests: DataFrame, request_key: str, records: DataFrame,
                   record_key: str) -> DataFrame:
    """Requests without any record (``left_anti``), with the not-found message."""
    rec_keys = records.select(F.col(record_key).cast("string").alias("_key"))
    req = requests.withColumn("_key", F.col(request_key).cast("string"))
    return (req.join(rec_keys, "_key", "left_anti")
            .withColumn("message", F.concat(F.lit("No record found for Animal ID "), F.col("_key")))
            .drop("_key"))


def validate_required(df: DataFrame, fields: Sequence[str], reason: str = "Missing data") -> DataFrame:
    """A row is rejected when any field is missing or blank after strip."""
    bad = None
    for c in fields:
        b = F.coalesce(py_strip(F.col(c).cast("string")), F.lit("")) == F.lit("")
        bad = b if bad is None else (bad | b)
    return (df.withColumn("accepted", ~bad)
            .withColumn("reason", F.when(bad, F.lit(reason))))


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """P5: names of 'string' or 'numeric' columns, from the schema."""
    from pyspark.sql.types import NumericType, StringType

    t = {"string": StringType, "numeric": NumericType}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, t)]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of_type(df, kind))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (column_name, value) pairs of the given text columns.

    Built as a narrow ``inline`` stack followed by one distinct (partial
    aggregation), so the shuffle carries distinct values only.
    """
    stacked = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                        for c in cols])
    return df.select(F.inline(stacked)).distinct()


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any of ``cols`` (default all)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def alias_value(df: DataFrame, names: Sequence[str], default: str = "",
                zero_falls_through: bool = False) -> Column:
    """P10: first value among the present alias columns that counts as given, else default.

    Null, '' and the text 'nan' do not count; with ``zero_falls_through``
    neither does a number 0 (records as numbers, where 0 is an empty value).
    """
    values = []
    for n in names:
        if n in df.columns:
            v = null_or_nan_text_to_empty(n)
            zero = F.coalesce(to_double(v) == 0.0, F.lit(False))
            values.append(F.when(~zero, v) if zero_falls_through else v)
    return first_non_blank(*values, default=default) if values else F.lit(default)


def extract_id(text: str | Column, mode: str = "digits") -> Column:
    """Id from scanned text: first ASCII digit run, or the whole text."""
    t = F.col(text) if isinstance(text, str) else text
    if mode == "raw":
        return t
    if mode != "digits":
        raise ValueError(mode)
    d = F.regexp_extract(t, "[0-9]+", 0)
    return F.when(d != F.lit(""), d)


def domain_violations(df: DataFrame, id_col: str = "animal_id") -> DataFrame:
    """(id, column, value, rule) for every value the input form would refuse.

    Checks are a literal stack of (column, value, rule) structs per row,
    then a filter: a narrow operator, no join.
    """
    checks = []

    def choice(c: str, allowed: Sequence[str]) -> Column:
        v = F.col(c).cast("string")
        return (F.when(F.coalesce(v, F.lit("")) == F.lit(""), F.lit("required"))
                .when(~v.isin(*allowed), F.lit("not a listed choice")))

    domains = {
        "species": FV.SPECIES_CHOICES, "sex": FV.SEX_CHOICES,
        "health_status": FV.HEALTH_STATUS_CHOICES,
        "symptom_1": FV.SYMPTOM_1_CHOICES, "symptom_2": FV.SYMPTOM_2_CHOICES,
    }
    for c, allowed in domains.items():
        checks.append(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                               choice(c, allowed).alias("rule")))
    for c in ["breed", "bp"]:
        v = F.col(c).cast("string")
        checks.append(F.struct(F.lit(c).alias("column_name"), v.alias("value"),
                               F.when(F.coalesce(v, F.lit("")) == F.lit(""),
                                      F.lit("required")).alias("rule")))
    hr = F.col("heart_rate").cast("string")
    checks.append(F.struct(F.lit("heart_rate").alias("column_name"), hr.alias("value"),
                           F.when(F.coalesce(hr, F.lit("")) == F.lit(""), F.lit("required"))
                           .when(~is_float_text(hr), F.lit("not a number")).alias("rule")))
    return (df.select(id_col, F.inline(F.array(*checks)))
            .where(F.col("rule").isNotNull()))
