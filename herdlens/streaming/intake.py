"""ST1: intake scoring as a Structured Streaming job.

Intake forms arrive as files. A form that lacks a required field is kept with
its reason and no scores. The others get the batch path's columns: rule label,
best keyword disease, integer vitals with the training medians as fallback, and
the chance of living of a fitted model if one is given. The medians are taken
once before the stream starts. Everything is stateless and narrow, and the
Parquet sink's commit log makes the output exactly-once across restarts. A model
whose trees lie in files is met by shuffles: each batch is then scored as a table
and written to its own folder (``batch=n``), which a batch run again overwrites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from herdlens import fixed_values as FV
from herdlens.operators import clean, filters, ml, rules
from herdlens.operators.dealt_forest import DealtForest
from herdlens.sources.tables import passing_scratch

REQUIRED = ["species", "breed", "sex", "bp", "heart_rate", "health_status"]
VITALS = ["heart_rate_in", "bp_systolic_in", "bp_diastolic_in"]


def training_medians(training: DataFrame) -> DataFrame:
    """The training frame's medians as a one-row frame, so that batches don't compute them again."""
    medians = clean.medians_of(training, FV.NUMERIC_FEATURES)
    row = [tuple(medians[c] for c in FV.NUMERIC_FEATURES)]
    return training.sparkSession.createDataFrame(row, ", ".join(f"{c} double" for c in FV.NUMERIC_FEATURES))


def score_intake(df: DataFrame, medians: DataFrame, model: ml.FittedClassifier | DealtForest | None = None,
                 required: Sequence[str] = REQUIRED) -> DataFrame:
    """(animal_id, accepted, reason, label, disease, vitals, chance_of_living) of intake forms."""
    df = filters.validate_required(df, required)
    df = rules.first_match_label(df, ["symptom_1", "symptom_2"], out_col="label")
    df = rules.keyword_top1(df, ["symptom_1", "symptom_2"], rules.DISEASES_26, out_col="disease")
    df = clean.intake_impute(df, medians)
    scores = ["label", "disease", *VITALS]
    if model is not None:
        keep = ["animal_id", "accepted", "reason", *scores]
        form = clean.constant_fill(df, text=["symptom_1", "symptom_2"])
        form = form.withColumns({c: F.col(f"{c}_in").cast("double") for c in FV.NUMERIC_FEATURES})
        df = model.predict(form, keep).withColumn("chance_of_living", model.class_probability_pct(FV.OUTCOME_LIVE))
        scores.append("chance_of_living")
    return df.select("animal_id", "accepted", "reason", *[F.when(F.col("accepted"), F.col(c)).alias(c) for c in scores])


def run_intake_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                      checkpoint_dir: str, medians: DataFrame, model_path: str | None = None,
                      files_per_trigger: int | None = None) -> None:
    """Score every file available now, then stop (``availableNow``); ``model_path`` names a saved model."""
    model = ml.FittedClassifier.load(spark, model_path) if model_path else None
    stream = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    if isinstance(model, DealtForest):
        def score(batch: DataFrame, number: int) -> None:
            with passing_scratch():
                scored = score_intake(batch, medians, ml.FittedClassifier.load(batch.sparkSession, model_path))
                scored.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

        stream.parquet(source_dir).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir).trigger(
            availableNow=True).start().awaitTermination()
        return
    q = (score_intake(stream.parquet(source_dir), medians, model)
         .writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
