"""Source / sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.plans import sql_parts as S
from herdlens.operators import updates
from herdlens.plans.q_updates import _MERGE_SQL, saved_form
from herdlens.plans.registry import query
from herdlens.sources import records, views
from herdlens.sources.tables import scratch_path

_COLS = views.RECORD_COLUMNS
_NA = S.in_list(FV.PANDAS_NA_TOKENS + [""])


@query("csv_record_scan", S.with_(S.ANIMAL) + "SELECT " + ", ".join(
    f"CASE WHEN CAST({c} AS VARCHAR) IN {_NA} THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}"
    for c in _COLS) + " FROM animal")
def csv_record_scan(spark, sf_dir):
    """Records written as header CSV into the shared folder, then scanned back."""
    path = scratch_path(spark, "records-csv")
    records.write_records_csv(views.animal(spark, sf_dir).select(*_COLS), path)
    missing = scratch_path(spark, "not-there")
    return records.read_records_csv(spark, [missing, path], _COLS, required=["bp", "heart_rate", "health_status"])


_HEADERS = {v: k for k, v in FV.RECORD_HEADERS.items()}


@query("csv_header_order", S.with_(S.ANIMAL) + "SELECT " + ", ".join(
    f"CASE WHEN CAST({c} AS VARCHAR) IN {_NA} THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}"
    for c in _COLS if c != "breed") + ", CAST(NULL AS VARCHAR) AS breed FROM animal")
def csv_header_order(spark, sf_dir):
    """A file with the record file's own headers, in another order, and without a breed."""
    path = scratch_path(spark, "records-csv")
    a = views.animal(spark, sf_dir).select(*[c for c in reversed(_COLS) if c != "breed"])
    records.write_records_csv(a, path, headers=_HEADERS)
    return records.read_records_csv(spark, path, _COLS)


_QUOTED_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS animal_id, 'He said "' || lang || '", ok' AS name,
 md5(text || chr(10) || '"' || source || '"') AS suggestion_md5 FROM documents"""


def _quoted_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "quoted-csv")
    d = views.documents(spark, sf_dir)
    rows = d.select(F.col("doc_id").alias("animal_id"), F.concat(F.lit('He said "'), "lang", F.lit('", ok')).alias("name"),
                    F.concat("text", F.lit('\n"'), "source", F.lit('"')).alias("doctor_suggestion"))
    records.write_records_csv(rows, path, headers=_HEADERS)
    return path


@query("csv_quoted_text", _QUOTED_SQL)
def csv_quoted_text(spark, sf_dir):
    """Free text with quotes, commas and line breaks through the file and back."""
    back = records.read_records_csv(spark, _quoted_file(spark, sf_dir))
    return back.select("animal_id", "name", F.md5("doctor_suggestion").alias("suggestion_md5"))


@query("csv_parallel_scan", _QUOTED_SQL)
def csv_parallel_scan(spark, sf_dir):
    """The same file, read by as many tasks as it has splits."""
    back = records.read_records_csv(spark, _quoted_file(spark, sf_dir), parallel=True)
    return back.select("animal_id", "name", F.md5("doctor_suggestion").alias("suggestion_md5"))


_REQUIRED = ["bp", "heart_rate", "age_years", "health_status", "disease", "symptom_1", "symptom_2",
             "oxygen_saturation_pct", "special_care"]


@query("required_columns_report", S.with_(S.ANIMAL) + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{c}' AS column_name, "
    + (f"true AS present, count({c}) AS non_null FROM animal" if c in _COLS
       else "false AS present, CAST(0 AS BIGINT) AS non_null")
    for i, c in enumerate(_REQUIRED, start=1)))
def required_columns_report(spark, sf_dir):
    return records.required_columns_report(views.animal(spark, sf_dir), _REQUIRED).withColumn(
        "ord", F.col("ord").cast("int"))


_BACKFILL = {"doctor_suggestion": "", "vaccination_1": "", "vaccination_2": "", "special_care": "",
             "disease": "Unknown", "symptom_1": "None", "symptom_2": "None"}


@query("optional_column_backfill", S.with_(S.ANIMAL) + """
SELECT animal_id, '' AS doctor_suggestion, '' AS vaccination_1, '' AS vaccination_2, '' AS special_care,
 disease, symptom_1, symptom_2 FROM animal""")
def optional_column_backfill(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "disease", "symptom_1", "symptom_2")
    return records.backfill_columns(a, _BACKFILL)


@query("table_save_roundtrip", _MERGE_SQL + "SELECT * FROM merged")
def table_save_roundtrip(spark, sf_dir):
    """Records saved as a bucketed table, edits merged into it, and the result saved as the next version."""
    name, path = f"records_{uuid.uuid4().hex}", scratch_path(spark, "records-table")
    base = views.dirty_animal(spark, sf_dir, input_order=True).drop("vaccination_1")
    records.save_table(base, name, buckets=8, path=path)
    records.save_table(saved_form(updates.record_update_merge(records.current_table(spark, name), views.record_updates(spark, sf_dir))),
                       name, buckets=8, path=path)
    return records.current_table(spark, name)
