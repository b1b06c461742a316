"""Update / merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.operators import clean, filters, updates
from herdlens.plans import sql_parts as S
from herdlens.plans.registry import query
from herdlens.sources import views

_REC = ["animal_id", "name", "species", "breed", "sex", "age_years", "bp", "heart_rate",
        "health_status", "symptom_1", "symptom_2", "disease"]
_OUT = _REC + ["doctor_suggestion", "special_care"]


def saved_form(merged: DataFrame) -> DataFrame:
    """Record columns as saved (missing -> '')."""
    return clean.null_to_empty(merged.select(*_OUT), [c for c in _OUT if c != "animal_id"])


def merged_records(spark, sf_dir) -> DataFrame:
    """Records after every edit."""
    base = views.dirty_animal(spark, sf_dir, input_order=True).drop("vaccination_1")
    return saved_form(updates.record_update_merge(base, views.record_updates(spark, sf_dir)))


_LATEST = """latest AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY ts DESC, seq DESC) AS rn
  FROM record_updates) WHERE rn = 1)"""
_MERGED = f"""merged AS (
 SELECT a.animal_id, coalesce(a.name, '') AS name, coalesce(a.species, '') AS species,
  coalesce(a.breed, '') AS breed, coalesce(a.sex, '') AS sex, coalesce(a.age_years, '') AS age_years,
  coalesce(a.bp, '') AS bp, coalesce(a.heart_rate, '') AS heart_rate,
  coalesce(a.health_status, '') AS health_status,
  CASE WHEN u.animal_id IS NULL THEN coalesce(a.symptom_1, '') ELSE coalesce({S.strip('u.symptom_1')}, '') END AS symptom_1,
  CASE WHEN u.animal_id IS NULL THEN coalesce(a.symptom_2, '') ELSE coalesce({S.strip('u.symptom_2')}, '') END AS symptom_2,
  coalesce(a.disease, '') AS disease,
  CASE WHEN u.animal_id IS NULL THEN '' ELSE coalesce({S.strip('u.suggestion')}, '') END AS doctor_suggestion,
  CASE WHEN u.animal_id IS NULL THEN '' WHEN coalesce(u.special_care, '') <> '' THEN 'Yes' ELSE 'No' END AS special_care
 FROM dirty a LEFT JOIN latest u ON a.animal_id = u.animal_id AND a.copy_no = 0)"""
_MERGE_SQL = S.with_(S.ANIMAL, S.DIRTY, S.RECORD_UPDATES, _LATEST, _MERGED)


@query("record_update_merge", _MERGE_SQL + "SELECT * FROM merged")
def record_update_merge(spark, sf_dir):
    return merged_records(spark, sf_dir)


@query("special_care_list", _MERGE_SQL
       + "SELECT animal_id, name, special_care FROM merged WHERE lower(special_care) = 'yes'")
def special_care_list(spark, sf_dir):
    m = merged_records(spark, sf_dir)
    return m.where(F.lower("special_care") == "yes").select("animal_id", "name", "special_care")


def accepted_vaccinations(spark, sf_dir) -> DataFrame:
    """Entries that pass the required-field check and name an existing record."""
    v = filters.validate_required(views.vaccinations(spark, sf_dir),
                                  ["animal_id", "vaccine", "vaccine_date"])
    v = v.where("accepted").withColumn("text", updates.vaccination_text())
    known = views.animal(spark, sf_dir).select("animal_id")
    return v.join(known, "animal_id", "left_semi").select("animal_id", "ts", "seq", "text")


_OK = f"""ok AS (
 SELECT v.animal_id, v.ts, v.seq, {S.strip('v.vaccine')} || ' (' || {S.strip('v.vaccine_date')} || ')' AS text
 FROM vaccinations v
 WHERE coalesce({S.strip('v.vaccine')}, '') <> '' AND coalesce({S.strip('v.vaccine_date')}, '') <> ''
   AND v.animal_id IN (SELECT animal_id FROM animal))"""
_RANKED = """ranked AS (
 SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY ts DESC, seq DESC) AS slot FROM ok)"""
_VAX = S.with_(S.ANIMAL, S.VACCINATIONS, _OK, _RANKED)


_ALIASES = ["age", "heart_rate_bpm", "oxygen_saturation_pct", "oxygen_saturation", "detected_disease"]


def current_records(spark, sf_dir) -> DataFrame:
    """Records after every edit and every accepted vaccination, as saved (missing -> '')."""
    base = views.dirty_animal(spark, sf_dir, input_order=True)
    pushed = updates.apply_changes(base, views.record_updates(spark, sf_dir), accepted_vaccinations(spark, sf_dir))
    cols = _OUT + ["vaccination_1", "vaccination_2", *_ALIASES, "copy_no"]
    return clean.null_to_empty(pushed.select(*cols), [c for c in cols if c not in ("animal_id", "copy_no")])


# The last two accepted entries per animal, pushed onto what its first record held.
_SLOTS = """slots AS (
 SELECT animal_id, max(CASE WHEN slot = 1 THEN text END) AS v1, max(CASE WHEN slot = 2 THEN text END) AS v2
 FROM ranked WHERE slot <= 2 GROUP BY animal_id)"""
_PUSHED = """coalesce(s.v1, d.vaccination_1, '') AS vaccination_1,
 CASE WHEN s.v1 IS NULL THEN '' ELSE coalesce(s.v2, d.vaccination_1, '') END AS vaccination_2"""
CURRENT_SQL = S.with_(S.ANIMAL, S.DIRTY, S.RECORD_UPDATES, _LATEST, _MERGED.replace(
    "SELECT a.animal_id,", "SELECT a.animal_id, a.copy_no,"), S.VACCINATIONS, _OK, _RANKED, _SLOTS, f"""current AS (
 SELECT m.*, {_PUSHED}, """ + ", ".join(f"coalesce(d.{c}, '') AS {c}" for c in _ALIASES) + """
 FROM merged m JOIN dirty d ON d.animal_id = m.animal_id AND d.copy_no = m.copy_no
 LEFT JOIN slots s ON s.animal_id = m.animal_id AND m.copy_no = 0)""")


PUSH_SQL = S.with_(S.ANIMAL, S.DIRTY, S.VACCINATIONS, _OK, _RANKED, _SLOTS) + f"""
SELECT d.animal_id, d.copy_no, {_PUSHED} FROM dirty d LEFT JOIN slots s ON s.animal_id = d.animal_id AND d.copy_no = 0"""


@query("vaccination_push", PUSH_SQL)
def vaccination_push(spark, sf_dir):
    base = views.dirty_animal(spark, sf_dir, input_order=True).select("animal_id", "copy_no", "vaccination_1", "_input_order")
    out = updates.vaccination_push(base, accepted_vaccinations(spark, sf_dir))
    return clean.null_to_empty(out.select("animal_id", "copy_no", "vaccination_1", "vaccination_2"),
                               ["vaccination_1", "vaccination_2"])


@query("vaccination_last_n", _VAX + """
SELECT animal_id, CAST(slot AS INT) AS slot, text AS vaccination FROM ranked WHERE slot <= 3""")
def vaccination_last_n(spark, sf_dir):
    top = updates.top_n_per_key(accepted_vaccinations(spark, sf_dir), "animal_id", ["ts", "seq"],
                                ["text"], 3)
    return top.select("animal_id", F.col("slot").cast("int").alias("slot"),
                      F.col("text").alias("vaccination"))
