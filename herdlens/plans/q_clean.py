"""Cleaning, imputation, projection and lookup queries (C1-C7, P1-P13, scalar)."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.text import join_pair, py_strip
from herdlens.operators import clean, filters
from herdlens.plans import sql_parts as S
from herdlens.plans.registry import query
from herdlens.sources import views

_TEXT_COLS = ["name", "species", "breed", "sex", "age_years", "bp", "heart_rate", "health_status",
              "symptom_1", "symptom_2", "disease"]


def _norm(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR lower(CAST({c} AS VARCHAR)) = 'nan' THEN '' "
            f"ELSE CAST({c} AS VARCHAR) END")


def _bp(part: int, col: str = "bp") -> str:
    return S.num(f"split_part({col}, '/', {part})")


@query("blank_normalise", S.with_(S.ANIMAL) + "SELECT animal_id, "
       + ", ".join(f"{_norm(c)} AS {c}" for c in _TEXT_COLS) + " FROM animal")
def blank_normalise(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    return clean.blank_normalise(a, _TEXT_COLS)


@query("numeric_coerce", S.with_(S.ANIMAL) + f"""
SELECT animal_id, {S.num('age_years')} AS age_years, {S.num('heart_rate')} AS heart_rate FROM animal""")
def numeric_coerce(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "age_years", "heart_rate")
    return clean.numeric_coerce(a, ["age_years", "heart_rate"])


@query("constant_fill", S.with_(S.ANIMAL) + f"""
SELECT animal_id, coalesce({S.num('age_years')}, 0.0) AS age_years,
 coalesce({S.num('heart_rate')}, 0.0) AS heart_rate,
 coalesce(symptom_1, 'None') AS symptom_1, coalesce(symptom_2, 'None') AS symptom_2 FROM animal""")
def constant_fill(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "age_years", "heart_rate", "symptom_1",
                                           "symptom_2")
    a = clean.numeric_coerce(a, ["age_years", "heart_rate"])
    return clean.constant_fill(a, numeric=["age_years", "heart_rate"],
                               text=["symptom_1", "symptom_2"])


@query("median_impute", S.with_(S.ANIMAL, f"""v AS (
 SELECT animal_id, {S.num('heart_rate')} AS heart_rate, {_bp(1)} AS bp_systolic, {_bp(2)} AS bp_diastolic
 FROM animal)""") + """
SELECT animal_id, coalesce(heart_rate, (SELECT median(heart_rate) FROM v)) AS heart_rate,
 coalesce(bp_systolic, (SELECT median(bp_systolic) FROM v)) AS bp_systolic,
 coalesce(bp_diastolic, (SELECT median(bp_diastolic) FROM v)) AS bp_diastolic FROM v""")
def median_impute(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "bp", "heart_rate")
    a = clean.bp_split(clean.numeric_coerce(a, ["heart_rate"])).drop("bp")
    return clean.median_impute(a, ["heart_rate", "bp_systolic", "bp_diastolic"])


@query("bp_zero_fill", S.with_(S.ANIMAL) + f"""
SELECT animal_id, coalesce({_bp(1)}, 0.0) AS bp_systolic, coalesce({_bp(2)}, 0.0) AS bp_diastolic
FROM animal""")
def bp_zero_fill(spark, sf_dir):
    a = clean.bp_split(views.animal(spark, sf_dir).select("animal_id", "bp"))
    return clean.constant_fill(a, numeric=["bp_systolic", "bp_diastolic"]).drop("bp")


@query("bp_split", S.with_(S.ANIMAL) + f"""
SELECT animal_id, {_bp(1)} AS bp_systolic, {_bp(2)} AS bp_diastolic FROM animal""")
def bp_split(spark, sf_dir):
    return clean.bp_split(views.animal(spark, sf_dir).select("animal_id", "bp")).drop("bp")


@query("bp_systolic_num", S.with_(S.ANIMAL) + f"""
SELECT animal_id, CASE WHEN bp IS NULL THEN NULL ELSE coalesce({_bp(1)}, 0.0) END AS bp_num FROM animal""")
def bp_systolic_num(spark, sf_dir):
    return clean.bp_systolic_num(views.animal(spark, sf_dir).select("animal_id", "bp")).drop("bp")


# Training frame (outcome, 'None' symptoms, BP zero-filled, heart rate median-filled).
_TRAIN = f"""train AS (
 SELECT animal_id, species, breed, sex, health_status,
  coalesce(symptom_1, 'None') AS symptom_1, coalesce(symptom_2, 'None') AS symptom_2, disease,
  CASE WHEN disease IN {S.in_list(FV.FATAL_DISEASES)} THEN {S.q(FV.OUTCOME_FATAL)}
       ELSE {S.q(FV.OUTCOME_LIVE)} END AS outcome,
  coalesce({_bp(1)}, 0.0) AS bp_systolic, coalesce({_bp(2)}, 0.0) AS bp_diastolic,
  {S.num('heart_rate')} AS hr0 FROM animal),
train_f AS (SELECT * EXCLUDE (hr0), coalesce(hr0, (SELECT median(hr0) FROM train)) AS heart_rate FROM train)"""


@query("feature_projection", S.with_(S.ANIMAL, _TRAIN) + """
SELECT animal_id, heart_rate, bp_systolic, bp_diastolic, species, breed, sex, health_status,
 symptom_1, symptom_2, outcome, disease FROM train_f""")
def feature_projection(spark, sf_dir):
    f = clean.model_features(views.animal(spark, sf_dir))
    return f.select("animal_id", *clean.NUMERIC_FEATURES, *clean.CATEGORICAL_FEATURES, "outcome",
                    "disease")


@query("intake_impute", S.with_(S.ANIMAL, _TRAIN) + f"""
, med AS (SELECT trunc(median(heart_rate))::BIGINT AS hr, trunc(median(bp_systolic))::BIGINT AS sy,
  trunc(median(bp_diastolic))::BIGINT AS di FROM train_f)
SELECT a.animal_id, coalesce({S.intval('a.heart_rate')}, med.hr) AS heart_rate_in,
 CASE WHEN len(string_split(a.bp, '/')) = 2 AND {S.intval("split_part(a.bp, '/', 1)")} IS NOT NULL
       AND {S.intval("split_part(a.bp, '/', 2)")} IS NOT NULL
      THEN {S.intval("split_part(a.bp, '/', 1)")} ELSE med.sy END AS bp_systolic_in,
 CASE WHEN len(string_split(a.bp, '/')) = 2 AND {S.intval("split_part(a.bp, '/', 1)")} IS NOT NULL
       AND {S.intval("split_part(a.bp, '/', 2)")} IS NOT NULL
      THEN {S.intval("split_part(a.bp, '/', 2)")} ELSE med.di END AS bp_diastolic_in
FROM animal a, med""")
def intake_impute(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    train = clean.model_features(a)
    out = clean.intake_impute(a.select("animal_id", "bp", "heart_rate"), train)
    return out.select("animal_id", "heart_rate_in", "bp_systolic_in", "bp_diastolic_in")


@query("fatal_outcome_label", S.with_(S.ANIMAL) + f"""
SELECT animal_id, disease, CASE WHEN disease IN {S.in_list(FV.FATAL_DISEASES)} THEN {S.q(FV.OUTCOME_FATAL)}
 ELSE {S.q(FV.OUTCOME_LIVE)} END AS outcome FROM animal""")
def fatal_outcome_label(spark, sf_dir):
    return clean.outcome_label(views.animal(spark, sf_dir).select("animal_id", "disease"))


@query("alias_coalesce", S.with_(S.ANIMAL, S.DIRTY) + f"""
SELECT animal_id, copy_no, {S.given('age_years', 'age', zero_falls_through=True)} AS age_text,
 {S.given('heart_rate', 'heart_rate_bpm', zero_falls_through=True)} AS heart_rate_text,
 {S.given('oxygen_saturation_pct', 'oxygen_saturation', zero_falls_through=True)} AS oxygen_text FROM dirty""")
def alias_coalesce(spark, sf_dir):
    a = views.dirty_animal(spark, sf_dir)
    return a.select(
        "animal_id", "copy_no",
        filters.alias_value(a, FV.AGE_NAMES, zero_falls_through=True).alias("age_text"),
        filters.alias_value(a, FV.HEART_RATE_NAMES, zero_falls_through=True).alias("heart_rate_text"),
        filters.alias_value(a, FV.OXYGEN_NAMES, zero_falls_through=True).alias("oxygen_text"))


# --- P4-P6: the model-comparison frame (BP split, text columns dropped) ---

_CMP_DROP = ["animal_id", "name", "species", "breed", "symptom_1", "symptom_2", "others"]
_CMP = f"""cmp AS (
 SELECT sex, age_years, heart_rate, health_status, disease,
  {_bp(1)} AS bp_systolic, {_bp(2)} AS bp_diastolic FROM animal)"""


def comparison_frame(spark, sf_dir):
    a = clean.bp_split(views.animal(spark, sf_dir)).drop("bp")
    return filters.drop_if_present(a, _CMP_DROP)


@query("drop_if_present", S.with_(S.ANIMAL, _CMP) + "SELECT * FROM cmp")
def drop_if_present(spark, sf_dir):
    return comparison_frame(spark, sf_dir)


@query("select_by_dtype", S.with_(S.ANIMAL, _CMP)
       + "SELECT sex, age_years, heart_rate, health_status, disease FROM cmp")
def select_by_dtype(spark, sf_dir):
    return filters.select_by_type(comparison_frame(spark, sf_dir), "string")


@query("non_numeric_profile", S.with_(S.ANIMAL, _CMP) + " UNION ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM cmp"
    for c in ["sex", "age_years", "heart_rate", "health_status", "disease"]))
def non_numeric_profile(spark, sf_dir):
    f = comparison_frame(spark, sf_dir)
    return filters.distinct_values(f, filters.columns_of_type(f, "string"))


# --- P1-P3, P11-P13 ---

@query("record_lookup", S.with_(S.ANIMAL, S.VACCINATIONS) + """
SELECT v.seq, v.animal_id, a.name, a.species, a.breed FROM vaccinations v
JOIN animal a ON CAST(a.animal_id AS VARCHAR) = CAST(v.animal_id AS VARCHAR)""")
def record_lookup(spark, sf_dir):
    req = views.vaccinations(spark, sf_dir).select("seq", "animal_id")
    rec = views.animal(spark, sf_dir, input_order=True).select(
        F.col("animal_id").alias("rec_id"), "name", "species", "breed", "_input_order")
    return filters.lookup(req, "animal_id", rec, "rec_id").drop("rec_id")


@query("record_lookup_missing", S.with_(S.ANIMAL, S.SCANS) + """
SELECT s.scan_id, s.scanned_text, 'No record found for Animal ID ' || s.scanned_text AS message
FROM scans s WHERE s.scanned_text NOT IN (SELECT CAST(animal_id AS VARCHAR) FROM animal)""")
def record_lookup_missing(spark, sf_dir):
    # Scan texts passed through whole (raw mode) as ids.
    req = views.scans(spark, sf_dir)
    rec = views.animal(spark, sf_dir).select("animal_id")
    return filters.lookup_missing(req, "scanned_text", rec, "animal_id")


@query("intake_validation", S.with_(S.VACCINATIONS) + f"""
SELECT seq, animal_id,
 NOT (coalesce({S.strip('CAST(animal_id AS VARCHAR)')}, '') = '' OR coalesce({S.strip('vaccine')}, '') = ''
      OR coalesce({S.strip('vaccine_date')}, '') = '') AS accepted,
 CASE WHEN coalesce({S.strip('CAST(animal_id AS VARCHAR)')}, '') = '' OR coalesce({S.strip('vaccine')}, '') = ''
      OR coalesce({S.strip('vaccine_date')}, '') = '' THEN 'Missing data' END AS reason
FROM vaccinations""")
def intake_validation(spark, sf_dir):
    v = views.vaccinations(spark, sf_dir).select("seq", "animal_id", "vaccine", "vaccine_date")
    return filters.validate_required(v, ["animal_id", "vaccine", "vaccine_date"]).select(
        "seq", "animal_id", "accepted", "reason")


@query("scan_id_extract", S.with_(S.SCANS) + f"""
SELECT scan_id, nullif(regexp_extract(scanned_text, '[0-9]+', 0), '') AS extracted_id,
 CASE WHEN regexp_extract(scanned_text, '[0-9]+', 0) = '' THEN {S.q(FV.NO_ID_STATUS)} ELSE 'ok' END AS status
FROM scans""")
def scan_id_extract(spark, sf_dir):
    s = views.scans(spark, sf_dir)
    ident = filters.extract_id("scanned_text")
    return s.select("scan_id", ident.alias("extracted_id"),
                    F.when(ident.isNull(), F.lit(FV.NO_ID_STATUS)).otherwise(F.lit("ok")).alias("status"))


@query("scan_lookup", S.with_(S.ANIMAL, S.SCANS) + """
SELECT s.scan_id, nullif(regexp_extract(s.scanned_text, '[0-9]+', 0), '') AS extracted_id,
 a.animal_id, a.name, a.animal_id IS NOT NULL AS found
FROM scans s LEFT JOIN animal a
  ON CAST(a.animal_id AS VARCHAR) = nullif(regexp_extract(s.scanned_text, '[0-9]+', 0), '')""")
def scan_lookup(spark, sf_dir):
    s = views.scans(spark, sf_dir).select("scan_id", filters.extract_id("scanned_text").alias("extracted_id"))
    rec = views.animal(spark, sf_dir, input_order=True).select("animal_id", "name", "_input_order")
    rec = rec.withColumnRenamed("animal_id", "rec_id")
    out = filters.lookup(s, "extracted_id", rec, "rec_id", how="left")
    return out.select("scan_id", "extracted_id", F.col("rec_id").alias("animal_id"), "name",
                      F.col("rec_id").isNotNull().alias("found"))


@query("scan_lookup_raw", S.with_(S.ANIMAL, S.DIRTY, S.SCANS) + """
SELECT s.scan_id, s.scanned_text, a.name, a.animal_id IS NOT NULL AS found
FROM scans s LEFT JOIN dirty a ON a.copy_no = 0 AND CAST(a.animal_id AS VARCHAR) = s.scanned_text""")
def scan_lookup_raw(spark, sf_dir):
    """The whole scanned text is the id; of repeated ids the first record counts."""
    s = views.scans(spark, sf_dir).withColumn("id_text", filters.extract_id("scanned_text", mode="raw"))
    rec = views.dirty_animal(spark, sf_dir, input_order=True).select(F.col("animal_id").alias("rec_id"), "name", "_input_order")
    out = filters.lookup(s, "id_text", rec, "rec_id", how="left")
    return out.select("scan_id", "scanned_text", "name", F.col("rec_id").isNotNull().alias("found"))


@query("domain_violations", S.with_(S.ANIMAL) + " UNION ALL ".join(
    [f"""SELECT animal_id, '{c}' AS column_name, {c} AS value,
  CASE WHEN coalesce({c}, '') = '' THEN 'required' ELSE 'not a listed choice' END AS rule
  FROM animal WHERE coalesce({c}, '') = '' OR {c} NOT IN {S.in_list(vals)}"""
     for c, vals in [("species", FV.SPECIES_CHOICES), ("sex", FV.SEX_CHOICES),
                     ("health_status", FV.HEALTH_STATUS_CHOICES),
                     ("symptom_1", FV.SYMPTOM_1_CHOICES), ("symptom_2", FV.SYMPTOM_2_CHOICES)]]
    + [f"SELECT animal_id, '{c}' AS column_name, {c} AS value, 'required' AS rule FROM animal "
       f"WHERE coalesce({c}, '') = ''" for c in ["breed", "bp"]]
    + [f"""SELECT animal_id, 'heart_rate' AS column_name, heart_rate AS value,
  CASE WHEN coalesce(heart_rate, '') = '' THEN 'required' ELSE 'not a number' END AS rule FROM animal
  WHERE coalesce(heart_rate, '') = '' OR NOT regexp_matches(heart_rate, {S.q(FV.FLOAT_PATTERN)})"""]))
def domain_violations(spark, sf_dir):
    return filters.domain_violations(views.animal(spark, sf_dir))


# --- scalar functions ---

@query("scalar_text_normalise", f"""
SELECT doc_id, md5(lower({S.strip('text')})) AS text_md5, length(lower({S.strip('text')})) AS n_chars,
 concat(lang, ' (', source, ')') AS origin FROM documents""")
def scalar_text_normalise(spark, sf_dir):
    d = views.documents(spark, sf_dir)
    norm = F.lower(py_strip("text"))
    return d.select("doc_id", F.md5(norm).alias("text_md5"), F.length(norm).cast("bigint").alias("n_chars"),
                    F.concat(F.col("lang"), F.lit(" ("), F.col("source"), F.lit(")")).alias("origin"))


@query("symptom_join_text", S.with_(S.ANIMAL) + f"""
SELECT animal_id, CASE WHEN {_norm('symptom_2')} <> '' THEN {_norm('symptom_1')} || ', ' || {_norm('symptom_2')}
 ELSE {_norm('symptom_1')} END AS symptoms FROM animal""")
def symptom_join_text(spark, sf_dir):
    a = clean.blank_normalise(views.animal(spark, sf_dir).select("animal_id", "symptom_1", "symptom_2"),
                              ["symptom_1", "symptom_2"])
    return a.select("animal_id", join_pair("symptom_1", "symptom_2").alias("symptoms"))

