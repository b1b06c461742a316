"""Report queries (RP1-RP3, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from herdlens import fixed_values as FV
from herdlens.operators import reports
from herdlens.plans import sql_parts as S
from herdlens.plans.q_updates import CURRENT_SQL, current_records
from herdlens.plans.registry import query
from herdlens.sources import records, views
from herdlens.sources.tables import scratch_path

_LINES = [
    S.shown("name"), S.shown("breed"), S.given("age_years", "age"), S.shown("bp"), S.given("heart_rate", "heart_rate_bpm"),
    S.given("oxygen_saturation_pct", "oxygen_saturation"),
    f"CASE WHEN {S.shown('symptom_2')} <> '' THEN {S.shown('symptom_1')} || ', ' || {S.shown('symptom_2')} ELSE {S.shown('symptom_1')} END",
    S.given("CASE WHEN animal_id % 9 = 0 THEN 'Asked' ELSE '' END", "detected_disease", "disease"), "'87.5%'",
    S.shown("vaccination_1"), S.shown("vaccination_2"), S.shown("doctor_suggestion"), S.shown("special_care"),
]

_REPORT_SQL = CURRENT_SQL + " UNION ALL ".join(
    f"SELECT animal_id, {i} AS line_no, {S.q(label)} AS label, {expr} AS text FROM current"
    for i, (label, expr) in enumerate(zip(FV.REPORT_LABELS, _LINES), start=1))

REPORT_SCHEMA = StructType([
    StructField("animal_id", LongType()), StructField("line_no", IntegerType()),
    StructField("label", StringType()), StructField("text", StringType()),
])


def _reports(spark, sf_dir):
    """Reports as asked for: some requests name a disease; the model accuracy is the caller's."""
    asked = F.when(F.col("animal_id") % 9 == 0, F.lit("Asked")).otherwise(F.lit(""))
    current = current_records(spark, sf_dir).withColumn("asked", asked)
    return reports.animal_report(current, accuracy_pct=87.5, request_col="asked")


@query("animal_report", _REPORT_SQL)
def animal_report(spark, sf_dir):
    return _reports(spark, sf_dir)


@query("report_sink_roundtrip", _REPORT_SQL)
def report_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "reports")
    records.write_reports(_reports(spark, sf_dir), path)
    return records.read_reports(spark, path, REPORT_SCHEMA)


@query("report_detected_only", S.with_(S.ANIMAL, S.DIRTY) + f"""
SELECT animal_id, copy_no, {S.given('detected_disease')} AS text FROM dirty""")
def report_detected_only(spark, sf_dir):
    """The one-column variant of the disease line."""
    a = views.dirty_animal(spark, sf_dir)
    return a.select("animal_id", "copy_no", reports.detected_disease(a, chain="detected").alias("text"))


@query("record_card", CURRENT_SQL + f"""
SELECT animal_id, lower(special_care) = 'yes' AS special_star, {S.shown('name')} AS name, breed,
 {S.given('age_years', 'age', zero_falls_through=True)} AS age, bp,
 {S.given('heart_rate', 'heart_rate_bpm', zero_falls_through=True)} AS heart_rate,
 {S.given('oxygen_saturation_pct', 'oxygen_saturation', zero_falls_through=True)} AS oxygen_saturation,
 CASE WHEN symptom_2 <> '' THEN symptom_1 || ', ' || symptom_2 ELSE symptom_1 END AS symptoms,
 vaccination_1, vaccination_2 FROM current""")
def record_card(spark, sf_dir):
    return reports.record_card(current_records(spark, sf_dir))
