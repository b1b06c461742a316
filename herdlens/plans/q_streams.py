"""Streaming queries (ST1, ST2): their final output equals the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdlens.plans.q_rules import _LABEL_RULES, _REQ, _RULES26
from herdlens.operators import clean, filters, ml, sketches, updates
from herdlens.plans.q_updates import _MERGE_SQL, _OUT, PUSH_SQL
from herdlens.plans import sql_parts as S
from herdlens.plans.q_clean import _TRAIN
from herdlens.plans.q_ml import fit_feature_model
from herdlens.plans.registry import query
from herdlens.sources import views
from herdlens.sources.tables import scratch_path
from herdlens.streaming import intake, scan_lookup, vaccination_state
from herdlens import fixed_values as FV


def _as_files(df, path: str, by) -> int:
    """Stage rows as Parquet files (the stream's input), as many as a shuffle makes; returns their number."""
    df.repartition(by).write.mode("errorifexists").parquet(path)
    return len(df.sparkSession.read.parquet(path).inputFiles())


def _third(files: int) -> int:
    """Files per trigger so that the stream takes about three batches."""
    return max(1, -(-files // 3))


_BLANK = " OR ".join(f"coalesce({S.strip(f'a.{c}')}, '') = ''" for c in intake.REQUIRED)
_PAIR = f"""len(string_split(a.bp, '/')) = 2 AND {S.intval("split_part(a.bp, '/', 1)")} IS NOT NULL
       AND {S.intval("split_part(a.bp, '/', 2)")} IS NOT NULL"""


@query("stream_intake_scoring", S.with_(S.ANIMAL, _RULES26, _LABEL_RULES, _REQ, _TRAIN, """sc AS (
 SELECT q.animal_id, r.ord, r.disease,
  sum(CAST(contains(q.s1, r.kw) AS INT) + CAST(contains(q.s2, r.kw) AS INT)) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""", f"""top AS (
 SELECT animal_id, CASE WHEN max(score) > 0 THEN arg_max(disease, score * 100000 - ord)
  ELSE {S.q(FV.NO_MATCH_LABEL)} END AS disease FROM sc GROUP BY animal_id)""", """hit AS (
 SELECT q.animal_id, min(r.ord) AS ord FROM req q JOIN lrules r
   ON contains(q.s1, r.kw) OR contains(q.s2, r.kw) GROUP BY q.animal_id)""", """med AS (
 SELECT trunc(median(heart_rate))::BIGINT AS hr, trunc(median(bp_systolic))::BIGINT AS sy, trunc(median(bp_diastolic))::BIGINT AS di FROM train_f)""",
 f"""s AS (SELECT a.animal_id, NOT ({_BLANK}) AS accepted, r.label, t.disease,
 coalesce({S.intval('a.heart_rate')}, med.hr) AS heart_rate_in,
 CASE WHEN {_PAIR} THEN {S.intval("split_part(a.bp, '/', 1)")} ELSE med.sy END AS bp_systolic_in,
 CASE WHEN {_PAIR} THEN {S.intval("split_part(a.bp, '/', 2)")} ELSE med.di END AS bp_diastolic_in
FROM animal a JOIN top t ON a.animal_id = t.animal_id CROSS JOIN med
LEFT JOIN hit h ON a.animal_id = h.animal_id LEFT JOIN lrules r ON r.ord = h.ord)""") + """
SELECT animal_id, accepted, CASE WHEN NOT accepted THEN 'Missing data' END AS reason, """ + ", ".join(
    f"CASE WHEN accepted THEN {c} END AS {c}" for c in ["label", "disease", *intake.VITALS])
    + ", accepted AS has_chance FROM s")
def stream_intake_scoring(spark, sf_dir):
    """Forms through the stream with a saved survival model; rejected forms have a reason and no scores.

    ``has_chance``: the stream's chance of living is the batch score of the same saved model.
    """
    forms = views.animal(spark, sf_dir)
    src, sink, ckpt, saved = (scratch_path(spark, p) for p in ("intake-src", "intake-out", "intake-ckpt", "intake-model"))
    files = _as_files(forms, src, F.col("animal_id"))
    fit_feature_model(spark, sf_dir, "outcome").save(spark, saved)
    medians = intake.training_medians(clean.model_features(forms))
    intake.run_intake_stream(spark, src, forms.schema, sink, ckpt, medians, saved, _third(files))
    batch = intake.score_intake(forms, medians, ml.FittedClassifier.load(spark, saved))
    out = spark.read.parquet(sink).drop("batch").join(batch.select("animal_id", F.col("chance_of_living").alias("batch_chance")), "animal_id")
    same = F.col("chance_of_living").between(0, 100) & (F.abs(F.col("chance_of_living") - F.col("batch_chance")) < 1e-9)
    return out.withColumn("has_chance", F.coalesce(same, F.lit(False))).drop("chance_of_living", "batch_chance")


@query("stream_vaccination_state", PUSH_SQL)
def stream_vaccination_state(spark, sf_dir):
    entries = views.vaccinations(spark, sf_dir)
    base = views.dirty_animal(spark, sf_dir, input_order=True).select("animal_id", "copy_no", "vaccination_1", "_input_order")
    src, ckpt = (scratch_path(spark, p) for p in ("vax-src", "vax-ckpt"))
    # Files are cut by a hash of the sequence, so arrival order is not event order.
    files = _as_files(entries, src, F.xxhash64("seq"))
    vaccination_state.run_vaccination_stream(spark, src, entries.schema, base, ckpt, _third(files))
    out = updates.vaccination_push(base, vaccination_state.read_vaccination_state(spark, ckpt))
    return clean.null_to_empty(out.select("animal_id", "copy_no", "vaccination_1", "vaccination_2"),
                               ["vaccination_1", "vaccination_2"])


@query("stream_record_state", _MERGE_SQL + "SELECT * FROM merged")
def stream_record_state(spark, sf_dir):
    edits = views.record_updates(spark, sf_dir)
    src, ckpt = (scratch_path(spark, p) for p in ("edit-src", "edit-ckpt"))
    files = _as_files(edits, src, F.xxhash64("seq"))
    vaccination_state.run_edit_stream(spark, src, edits.schema, ckpt, _third(files))
    base = views.dirty_animal(spark, sf_dir, input_order=True).drop("vaccination_1")
    merged = updates.record_update_merge(base, vaccination_state.read_edit_state(spark, ckpt))
    return clean.null_to_empty(merged.select(*_OUT), [c for c in _OUT if c != "animal_id"])


@query("stream_scan_lookup", S.with_(S.ANIMAL, S.DIRTY, S.SCANS) + f"""
SELECT s.scan_id, s.id AS extracted_id, a.animal_id, a.name,
 CASE WHEN s.id IS NULL THEN {S.q(FV.NO_ID_STATUS)} WHEN a.animal_id IS NULL THEN 'No record found for Animal ID ' || s.id END AS message
FROM (SELECT scan_id, nullif(regexp_extract(scanned_text, '[0-9]+', 0), '') AS id FROM scans) s
LEFT JOIN dirty a ON a.copy_no = 0 AND CAST(a.animal_id AS VARCHAR) = s.id""")
def stream_scan_lookup(spark, sf_dir):
    """Scans as a stream of files: those with a record and those without, from both sinks."""
    scans = views.scans(spark, sf_dir)
    src, found, missing, ckpt = (scratch_path(spark, p) for p in ("scan-src", "scan-found", "scan-missing", "scan-ckpt"))
    files = _as_files(scans, src, F.col("scan_id"))
    rec = views.dirty_animal(spark, sf_dir, input_order=True).select("animal_id", "name", filters.ORDER_COL)
    scan_lookup.run_scan_stream(spark, src, scans.schema, rec, "animal_id", found, missing, ckpt, files_per_trigger=_third(files))
    out = spark.read.parquet(found).unionByName(spark.read.parquet(missing), allowMissingColumns=True)
    return out.select("scan_id", "extracted_id", "animal_id", "name", "message")


def _numeric(records):
    return clean.bp_split(clean.numeric_coerce(records, ["heart_rate"]))


@query("stream_median_sketches", S.with_(S.ANIMAL) + " UNION ALL ".join(
    f"SELECT {S.q(c)} AS column_name, count({e}) AS n, true AS near_median FROM animal"
    for c, e in zip(FV.NUMERIC_FEATURES, [S.num("heart_rate"), *(S.num(f"split_part(bp, '/', {i})") for i in (1, 2))])))
def stream_median_sketches(spark, sf_dir):
    """Medians that follow a stream of record files: one sketch a file, merged; their exact ranks are near the middle."""
    records = views.animal(spark, sf_dir).select("animal_id", "bp", "heart_rate")
    src, out, ckpt = (scratch_path(spark, p) for p in ("median-src", "median-sketches", "median-ckpt"))
    files = _as_files(records, src, F.col("animal_id"))
    cols = FV.NUMERIC_FEATURES
    sketches.run_sketch_stream(spark, src, records.schema, _numeric, cols, out, ckpt, _third(files))
    medians = sketches.quantiles(sketches.read_sketches(spark, out), cols)
    values = ml.stack_columns(_numeric(records), [], cols).where(F.col("value").isNotNull())
    # Three rows of medians.
    ranks = values.join(F.broadcast(medians), "column_name").groupBy("column_name", "n").agg(
        F.avg((F.col("value").cast("double") < F.col("quantile")).cast("int")).alias("below"),
        F.avg((F.col("value").cast("double") <= F.col("quantile")).cast("int")).alias("upto"))
    near = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    return ranks.select("column_name", "n", near.alias("near_median"))
