"""One-hot places without a vocabulary on the driver, and a model fitted on them."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import clean, ml
from herdlens.operators.encoders import WideOneHot
from herdlens.plans import sql_parts as S
from herdlens.plans.q_ml import _HASH
from herdlens.plans.registry import query
from herdlens.sources import views

#: A name has as many values as there are records.
WIDE = ["name", "symptom_2", "symptom_1", "disease"]

_ODD = {c: c for c in WIDE} | {"symptom_1": "CASE WHEN animal_id % 3 = 0 THEN lower(symptom_1) ELSE symptom_1 END"}


@query("wide_one_hot", S.with_(S.ANIMAL, f"train AS (SELECT * FROM animal WHERE {_HASH} <> 0)", "vocab AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS place FROM ("
       + " UNION ".join(f"SELECT {i} AS c, {c} AS v FROM train WHERE {c} IS NOT NULL" for i, c in enumerate(WIDE)) + "))",
       "odd AS (" + " UNION ALL ".join(f"SELECT animal_id, {i} AS c, {_ODD[c]} AS v FROM animal" for i, c in enumerate(WIDE)) + ")")
       + "SELECT o.animal_id, v.place FROM odd o JOIN vocab v ON o.c = v.c AND o.v = v.v")
def wide_one_hot(spark, sf_dir):
    a = ml.hash_split(views.animal(spark, sf_dir), "animal_id")
    encoder = WideOneHot.fit(a.where(F.col("split") == "train"), WIDE)
    odd = a.select("animal_id", *[F.expr(e).alias(c) for c, e in _ODD.items()])
    return encoder.places(odd).select("animal_id", F.explode(F.col("places").cast("array<long>")).alias("place"))


@query("wide_svm_check", S.with_(S.ANIMAL) + f"""SELECT count(*) AS n_test, true AS mostly_right FROM animal WHERE {_HASH} = 0""")
def wide_svm_check(spark, sf_dir):
    """A linear SVM on the vectors: the outcome follows from the disease, so 95 % of the test rows at least are right."""
    a = ml.hash_split(clean.outcome_label(views.animal(spark, sf_dir), out="outcome"), "animal_id")
    a = a.withColumn("label", (F.col("outcome") == FV.OUTCOME_FATAL).cast("double"))
    encoder = WideOneHot.fit(a.where(F.col("split") == "train"), WIDE)
    rows = encoder.vectors(a.select("split", "label", *WIDE))
    model = LinearSVC(maxIter=50).fit(rows.where(F.col("split") == "train"))
    said = model.transform(rows.where(F.col("split") == "test"))
    right = F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0))
    return said.agg(F.count(F.lit(1)).alias("n_test"), (right >= 0.95).alias("mostly_right"))
