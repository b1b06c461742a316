"""Reports, the special care list and an accuracy kept up to date from changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import clean, ml, reports, rules
from herdlens.operators.refresh import COPIES, RefreshedViews, parts_for
from herdlens.plans import sql_parts as S
from herdlens.plans.q_ml import _SPLIT
from herdlens.plans.q_reports import _REPORT_SQL
from herdlens.plans.q_rules import _LABEL_RULES
from herdlens.plans.q_updates import _MERGE_SQL, accepted_vaccinations
from herdlens.plans.registry import query
from herdlens.sources import views
from herdlens.sources.tables import scratch_path


def report_lines(records: DataFrame) -> DataFrame:
    texts = [f.name for f in records.schema if f.dataType.typeName() == "string"]
    asked = F.when(F.col("animal_id") % 9 == 0, F.lit("Asked")).otherwise(F.lit(""))
    saved = clean.null_to_empty(records, texts).withColumn("asked", asked)
    # Copies of an id have lines of their own, equal or not.
    return reports.animal_report(saved, accuracy_pct=87.5, request_col="asked")


def special_care(records: DataFrame) -> DataFrame:
    return (records.where(F.lower("special_care") == "yes")
            .select("animal_id", F.coalesce("name", F.lit("")).alias("name"), "special_care"))


def quick_label_hits(records: DataFrame) -> DataFrame:
    """(split, hit): whether a quick-label match goes with a fatal disease; no key, so its bag is a count."""
    a = rules.first_match_label(clean.outcome_label(records, out="actual"), ["symptom_1", "symptom_2"])
    said = F.when(F.col("label").isNull(), F.lit(FV.OUTCOME_LIVE)).otherwise(F.lit(FV.OUTCOME_FATAL))
    return ml.hash_split(a, "animal_id").select("split", (said == F.col("actual")).alias("hit"))


VIEWS = {"report": report_lines, "special_care": special_care, "hits": quick_label_hits}


def record_base(spark, sf_dir) -> DataFrame:
    """Records before any change."""
    base = views.dirty_animal(spark, sf_dir, input_order=True)
    return base.withColumns({c: F.lit("") for c in ("doctor_suggestion", "special_care", "vaccination_2")})


def change_batches(spark, sf_dir) -> list[tuple[DataFrame, DataFrame]]:
    """(edits, accepted vaccinations) of three spans of time, in order."""
    edits, entries = views.record_updates(spark, sf_dir), accepted_vaccinations(spark, sf_dir)
    year, day = F.year("ts"), F.dayofmonth("ts")
    return [(edits.where(year < 1997), entries.where(day <= 10)),
            (edits.where((year >= 1997) & (year < 1999)), entries.where((day > 10) & (day <= 20))),
            (edits.where(year >= 1999), entries.where(day > 20))]


def refreshed(spark, sf_dir, *names: str) -> RefreshedViews:
    """The views ``names`` after the load and all three batches."""
    base = record_base(spark, sf_dir)
    kept = RefreshedViews(spark, scratch_path(spark, "refreshed"), base.schema, {n: VIEWS[n] for n in names},
                          parts=parts_for(base))
    kept.load(base)
    for batch, (edits, entries) in enumerate(change_batches(spark, sf_dir), 1):
        kept.refresh(batch, edits, entries)
    return kept


@query("report_refresh", _REPORT_SQL)
def report_refresh(spark, sf_dir):
    return refreshed(spark, sf_dir, "report").rows("report")


@query("special_care_refresh", _MERGE_SQL
       + "SELECT animal_id, name, special_care FROM merged WHERE lower(special_care) = 'yes'")
def special_care_refresh(spark, sf_dir):
    return refreshed(spark, sf_dir, "special_care").rows("special_care")


@query("accuracy_refresh", _MERGE_SQL.rstrip() + f""",
{_LABEL_RULES},
j AS (SELECT {_SPLIT} AS split,
 (disease IN {S.in_list(FV.FATAL_DISEASES)})
  = EXISTS (SELECT 1 FROM lrules r WHERE contains({S.sym('symptom_1')}, r.kw) OR contains({S.sym('symptom_2')}, r.kw)) AS hit
 FROM merged)
SELECT split, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS correct,
 round(sum(CAST(hit AS INT)) * 100.0 / count(*), 2) AS accuracy_pct FROM j GROUP BY split""")
def accuracy_refresh(spark, sf_dir):
    bag = refreshed(spark, sf_dir, "hits").bag("hits")
    right = F.sum(F.when(F.col("hit"), F.col(COPIES)).otherwise(0))
    return (bag.groupBy("split").agg(F.sum(COPIES).alias("n"), right.alias("correct"))
            .withColumn("accuracy_pct", F.bround(F.col("correct") * 100.0 / F.col("n"), 2)))
