"""Record-shaped views derived from the base tables.

The reference works on one flat CSV of animal health records that is not
shipped, so the record table and its change streams are derived, column by
column, from the base tables (``customer``, ``orders``, ``events``,
``pages``). The derivations are narrow projections: no shuffle, no join, so
they scale with the base scans and keep filter/column pushdown intact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.sources.tables import read_table

# FIXED VALUES of the derivation (choice lists indexed by key arithmetic).
_SPECIES = FV.SPECIES_CHOICES
_SEX = FV.SEX_CHOICES
_STATUS = FV.HEALTH_STATUS_CHOICES
_SYMPTOM_1 = FV.SYMPTOM_1_CHOICES
_SYMPTOM_2 = FV.SYMPTOM_2_CHOICES
_DISEASE = ["Rabies", "Anthrax", "PPR (Peste des petits ruminants)", "FMD", "Mastitis",
            "Brucellosis", "Newcastle Disease", "Tick Fever"]
_UPDATE_SYMPTOM_1 = ["  Fever ", "Cough", "", "Vomiting", "Swollen udder"]
_UPDATE_SYMPTOM_2 = ["Diarrhea", "", "Nasal discharge", "Drooling"]
_VACCINES = ["FMD", "HS", "BQ", "Anthrax", "Tetanus", "Rabies", "Parvo", "Distemper",
             "Leptospirosis", "Feline Panleukopenia"]

RECORD_COLUMNS = ["animal_id", "name", "species", "breed", "sex", "age_years", "bp", "heart_rate",
                  "health_status", "symptom_1", "symptom_2", "disease"]


def _pick(values: list[str], index0: Column) -> Column:
    """values[index0] for a 0-based bigint index, as a literal-array lookup."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index0 + 1).cast("int"))


def animal(spark: SparkSession, sf_dir: str, input_order: bool = False) -> DataFrame:
    """Animal health records, one per customer key (dirty on purpose).

    ``input_order=True`` adds ``_input_order`` (file, row index) taken from the
    Parquet scan metadata, used where "first record in the file wins".
    """
    k = F.col("c_custkey")
    txt = lambda c: c.cast("string")
    base = read_table(spark, sf_dir, "customer")
    order = ([F.struct(F.col("_metadata.file_path").alias("f"),
                       F.col("_metadata.row_index").alias("r")).alias("_input_order")]
             if input_order else [])
    return base.select(
        k.alias("animal_id"),
        F.col("c_name").alias("name"),
        _pick(_SPECIES, k % 7).alias("species"),
        F.col("c_mktsegment").alias("breed"),
        _pick(_SEX, k % 2).alias("sex"),
        F.when(k % 41 != 0, txt(k % 15)).alias("age_years"),
        (F.when(k % 37 == 0, F.lit(None).cast("string"))
         .when(k % 31 == 0, F.lit("unknown"))
         .when(k % 29 == 0, txt(90 + k % 60))
         .otherwise(F.concat(txt(90 + k % 60), F.lit("/"), txt(50 + (k * 7) % 45)))).alias("bp"),
        (F.when(k % 43 == 0, F.lit(None).cast("string"))
         .when(k % 47 == 0, F.lit("abc"))
         .otherwise(txt(40 + (k * 13) % 90))).alias("heart_rate"),
        _pick(_STATUS, (k * 5) % 11).alias("health_status"),
        F.when(k % 10 != 0, _pick(_SYMPTOM_1, (k * 3) % 10)).alias("symptom_1"),
        F.when(k % 9 != 0, _pick(_SYMPTOM_2, (k * 7 + k % 3) % 10)).alias("symptom_2"),
        _pick(_DISEASE, (k * 11) % 8).alias("disease"),
        *order,
    )


def dirty_animal(spark: SparkSession, sf_dir: str, input_order: bool = False) -> DataFrame:
    """Records as a busy clinic keeps them: 'nan' texts, zero vitals, alias columns and repeated ids.

    Every 50th id has a second row (``copy_no`` 1), which stands after the first in input order.
    """
    k = F.col("animal_id")
    txt = lambda c: c.cast("string")
    a = animal(spark, sf_dir, input_order)
    a = a.withColumn("copy_no", F.explode(F.when(k % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    if input_order:
        a = a.withColumn("_input_order", F.struct("_input_order.f", "_input_order.r", "copy_no"))
    return a.withColumns({
        "name": F.when(k % 29 == 0, F.lit("NaN")).otherwise(F.concat("name", F.when(F.col("copy_no") == 1, F.lit(" copy")).otherwise(F.lit("")))),
        "age_years": F.when(k % 13 == 0, F.lit("nan")).when(k % 11 == 0, F.lit("0.0")).otherwise(F.col("age_years")),
        "age": F.when(k % 3 != 0, txt(k % 20)),
        "heart_rate": F.when(k % 17 == 0, F.lit("0")).when(k % 19 == 0, F.lit("NaN")).otherwise(F.col("heart_rate")),
        "heart_rate_bpm": F.when(k % 5 != 0, txt(60 + k % 50)),
        "oxygen_saturation_pct": F.when(k % 4 == 0, F.lit("nan")).when(k % 3 != 0, txt(90 + k % 10)),
        "oxygen_saturation": F.when(k % 2 == 0, F.lit("88")).otherwise(F.lit("")),
        "detected_disease": F.when(k % 4 == 0, F.lit("nan")).when(k % 4 == 1, F.lit("Tick Fever")),
        "vaccination_1": F.when(k % 6 == 0, F.concat(F.lit("Old ("), txt(2000 + k % 20), F.lit(")"))),
    })


def record_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record edit events: several per animal; the last by (ts, seq) wins."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"])
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("animal_id"),
        F.col("o_orderdate").alias("ts"),
        key.alias("seq"),
        _pick(_UPDATE_SYMPTOM_1, key % 5).alias("symptom_1"),
        _pick(_UPDATE_SYMPTOM_2, key % 4).alias("symptom_2"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("suggestion"),
        F.when(F.col("o_orderstatus") == "F", F.lit("on")).alias("special_care"),
    )


def vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vaccination entries (some with a blank name, to be rejected)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    eid = F.col("event_id")
    return e.select(
        F.col("user_id").alias("animal_id"),
        F.col("ts"),
        eid.alias("seq"),
        F.when(eid % 53 == 0, F.lit("  ")).otherwise(_pick(_VACCINES, eid % 10)).alias("vaccine"),
        F.col("ts").cast("date").cast("string").alias("vaccine_date"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded scan texts: bare ids, ids without a record, texts without digits, and urls."""
    k = F.col("page_id")
    text = (F.when(k % 3 == 0, k.cast("string")).when(k % 5 == 0, F.concat(F.lit("Animal #"), (k + 90_000_000).cast("string")))
            .when(k % 7 == 0, F.lit("no number here")).otherwise(F.col("url")))
    return read_table(spark, sf_dir, "pages", ["page_id", "url"]).select(k.alias("scan_id"), text.alias("scanned_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
