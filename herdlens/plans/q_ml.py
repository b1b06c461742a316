"""Model queries (M1-M12, R5 complete).

Split, scaling, encodings and accuracy have SQL oracles. Seeds and tree
construction differ between libraries, so model outputs have none; each model
has a ``_check`` key instead, which computes from its predictions what must
hold of any fit, against SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.bp import bp_part
from herdlens.functions.numbers import to_double
from herdlens.functions.text import symptom_text
from herdlens.operators import clean, filters, ml, rules
from herdlens.plans import sql_parts as S
from herdlens.plans.q_clean import _TRAIN, _bp
from herdlens.plans.q_rules import _DIAG_RULES_SQL, _LABEL_RULES, _REQ
from herdlens.plans.registry import query
from herdlens.sources import records, views
from herdlens.sources.tables import stored

_HASH = "CAST(('0x' || substr(md5(CAST(animal_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5"
_SPLIT = f"CASE WHEN {_HASH} = 0 THEN 'test' ELSE 'train' END"


def _features(spark, sf_dir) -> DataFrame:
    return clean.model_features(views.animal(spark, sf_dir))


@query("hash_split", S.with_(S.ANIMAL) + f"SELECT animal_id, {_SPLIT} AS split FROM animal")
def hash_split(spark, sf_dir):
    return ml.hash_split(views.animal(spark, sf_dir).select("animal_id"), "animal_id")


@query("standard_scale", S.with_(S.ANIMAL, _TRAIN) + """
SELECT animal_id,
 round((heart_rate - (SELECT avg(heart_rate) FROM train_f)) / (SELECT CASE WHEN stddev_pop(heart_rate) = 0 THEN 1.0 ELSE stddev_pop(heart_rate) END FROM train_f), 6) AS heart_rate,
 round((bp_systolic - (SELECT avg(bp_systolic) FROM train_f)) / (SELECT CASE WHEN stddev_pop(bp_systolic) = 0 THEN 1.0 ELSE stddev_pop(bp_systolic) END FROM train_f), 6) AS bp_systolic,
 round((bp_diastolic - (SELECT avg(bp_diastolic) FROM train_f)) / (SELECT CASE WHEN stddev_pop(bp_diastolic) = 0 THEN 1.0 ELSE stddev_pop(bp_diastolic) END FROM train_f), 6) AS bp_diastolic
FROM train_f""")
def standard_scale(spark, sf_dir):
    f = _features(spark, sf_dir).select("animal_id", *clean.NUMERIC_FEATURES)
    s = ml.standard_scale(f, clean.NUMERIC_FEATURES)
    return s.select("animal_id", *[F.round(c, 6).alias(c) for c in clean.NUMERIC_FEATURES])


_CATS = clean.CATEGORICAL_FEATURES


def _stack_sql(src: str, cols, id_col: str | None = "animal_id") -> str:
    idc = f"{id_col}, " if id_col else ""
    return " UNION ALL ".join(f"SELECT {idc}'{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}"
                              for c in cols)


@query("one_hot_long", S.with_(S.ANIMAL, _TRAIN, f"""long AS ({_stack_sql('train_f', _CATS)}),
vocab AS (SELECT DISTINCT column_name, value FROM long
          WHERE value IS NOT NULL AND {_SPLIT.replace('animal_id', 'long.animal_id')} = 'train')""") + """
SELECT l.animal_id, l.column_name, l.value AS category FROM long l
WHERE l.value IS NOT NULL AND (l.column_name, l.value) IN (SELECT (column_name, value) FROM vocab)""")
def one_hot_long(spark, sf_dir):
    f = ml.hash_split(_features(spark, sf_dir), "animal_id")
    return ml.one_hot_long(f, ["animal_id"], _CATS, f.where(F.col("split") == "train"))


_ENC_COLS = ["sex", "age_years", "heart_rate", "health_status", "disease"]
_CMP_ID = f"""cmp AS (
 SELECT animal_id, sex, age_years, heart_rate, health_status, disease,
  {_bp(1)} AS bp_systolic, {_bp(2)} AS bp_diastolic FROM animal),
codes AS (SELECT column_name, value, CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT column_name, coalesce(value, 'nan') AS value FROM ({_stack_sql('cmp', _ENC_COLS, None)})))"""
_ENCODED = "SELECT c.animal_id, " + ", ".join(
    f"(SELECT code FROM codes k WHERE k.column_name = '{col}' AND k.value = coalesce(c.{col}, 'nan')) AS {col}"
    for col in _ENC_COLS) + ", c.bp_systolic, c.bp_diastolic FROM cmp c"


def encoded_comparison_frame(spark, sf_dir) -> DataFrame:
    a = clean.bp_split(views.animal(spark, sf_dir)).drop("bp")
    f = filters.drop_if_present(a, ["name", "species", "breed", "symptom_1", "symptom_2", "others"])
    return ml.label_encode(f, _ENC_COLS)


@query("label_encode", S.with_(S.ANIMAL, _CMP_ID) + _ENCODED)
def label_encode(spark, sf_dir):
    return encoded_comparison_frame(spark, sf_dir).select("animal_id", *_ENC_COLS, "bp_systolic",
                                                           "bp_diastolic")


@query("drop_null_rows", S.with_(S.ANIMAL, _CMP_ID, f"enc AS ({_ENCODED})")
       + "SELECT * FROM enc WHERE bp_systolic IS NOT NULL AND bp_diastolic IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    f = encoded_comparison_frame(spark, sf_dir).select("animal_id", *_ENC_COLS, "bp_systolic",
                                                        "bp_diastolic")
    return filters.drop_null_rows(f)


@query("accuracy_metric", S.with_(S.ANIMAL, _LABEL_RULES, _REQ, """hit AS (
 SELECT q.animal_id, min(r.ord) AS ord FROM req q JOIN lrules r
   ON contains(q.s1, r.kw) OR contains(q.s2, r.kw) GROUP BY q.animal_id)""", f"""j AS (
 SELECT a.animal_id, {_SPLIT.replace('animal_id', 'a.animal_id')} AS split,
  CASE WHEN a.disease IN {S.in_list(FV.FATAL_DISEASES)} THEN {S.q(FV.OUTCOME_FATAL)} ELSE {S.q(FV.OUTCOME_LIVE)} END AS actual,
  CASE WHEN r.label IS NULL THEN {S.q(FV.OUTCOME_LIVE)} ELSE {S.q(FV.OUTCOME_FATAL)} END AS said
 FROM animal a LEFT JOIN hit h ON a.animal_id = h.animal_id LEFT JOIN lrules r ON r.ord = h.ord)""") + """
SELECT split, count(*) AS n, CAST(sum(CASE WHEN said = actual THEN 1 ELSE 0 END) AS BIGINT) AS correct,
 round(sum(CASE WHEN said = actual THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS accuracy_pct
FROM j GROUP BY split""")
def accuracy_metric(spark, sf_dir):
    """Accuracy of a stand-in prediction: a quick-label hit counts as fatal, anything else as not."""
    a = clean.outcome_label(views.animal(spark, sf_dir), out="actual")
    a = rules.first_match_label(a, ["symptom_1", "symptom_2"])
    a = a.withColumn("said", F.when(F.col("label").isNull(), F.lit(FV.OUTCOME_LIVE)).otherwise(F.lit(FV.OUTCOME_FATAL)))
    return ml.accuracy(ml.hash_split(a, "animal_id"), "said", "actual", ["split"])


# --- models (rows-only checks) ---

HEALTH_REQUIRED = ["bp", "heart_rate", "age_years", "health_status"]


def health_frame(spark, sf_dir) -> DataFrame:
    a = records.require_columns(views.animal(spark, sf_dir), HEALTH_REQUIRED)
    h = clean.health_features(a)
    # MLlib trees take no missing values: a missing systolic is fed as 0.0.
    h = h.withColumn("bp_num", F.coalesce(F.col("bp_num"), F.lit(0.0)))
    return ml.hash_split(h, "animal_id")


HEALTH_NUMERIC = ["bp_num", "heart_rate_num", "age_num"]


def fit_health_model(spark, sf_dir, num_trees: int = 100, max_depth: int = 30):
    train = health_frame(spark, sf_dir).where(F.col("split") == "train")
    return ml.fit_classifier(train, HEALTH_NUMERIC, [], "label_text",
                             ml.forest("label_idx", num_trees=num_trees, max_depth=max_depth), scale=False)


@query("health_status_forest")
def health_status_forest(spark, sf_dir):
    model = fit_health_model(spark, sf_dir)
    test = health_frame(spark, sf_dir).where(F.col("split") == "test")
    return model.predict(test, ["animal_id", "label_text"]).select(
        "animal_id", F.col("label_text").alias("health_status"), "predicted_label")


def fit_feature_model(spark, sf_dir, target: str, num_trees: int = 100, max_depth: int = 30):
    f = _features(spark, sf_dir)
    return ml.fit_classifier(f, clean.NUMERIC_FEATURES, _CATS, target,
                             ml.forest("label_idx", num_trees=num_trees, max_depth=max_depth))


@query("survival_forest")
def survival_forest(spark, sf_dir):
    model = fit_feature_model(spark, sf_dir, "outcome")
    out = model.predict(_features(spark, sf_dir), ["animal_id", "outcome"])
    return out.select("animal_id", "outcome", "predicted_label",
                      model.class_probability_pct(FV.OUTCOME_LIVE).alias("chance_of_living"))


@query("disease_forest")
def disease_forest(spark, sf_dir):
    model = fit_feature_model(spark, sf_dir, "disease")
    return model.predict(_features(spark, sf_dir), ["animal_id", "disease"]).select(
        "animal_id", "disease", "predicted_label")


def intake_forms(spark, sf_dir, lowercase_request: bool = False) -> DataFrame:
    """Every record as an intake form: integer vitals with median fallbacks.

    ``lowercase_request`` strips and lower-cases the symptoms of the request,
    as one variant of the form does; the model then sees them as typed so.
    """
    a = views.animal(spark, sf_dir)
    intake = clean.intake_impute(a, clean.model_features(a))
    intake = clean.constant_fill(intake, text=["symptom_1", "symptom_2"])
    if lowercase_request:
        intake = intake.withColumns({c: symptom_text(c) for c in ("symptom_1", "symptom_2")})
    return intake.select("animal_id", *_CATS,
                         F.col("heart_rate_in").cast("double").alias("heart_rate"),
                         F.col("bp_systolic_in").cast("double").alias("bp_systolic"),
                         F.col("bp_diastolic_in").cast("double").alias("bp_diastolic"))


@query("chance_of_living")
def chance_of_living(spark, sf_dir, lowercase_request: bool = False):
    model = fit_feature_model(spark, sf_dir, "outcome")
    out = model.predict(intake_forms(spark, sf_dir, lowercase_request), ["animal_id"])
    return out.select("animal_id", F.col("predicted_label").alias("predicted_outcome"),
                      model.class_probability_pct(FV.OUTCOME_LIVE).alias("chance_of_living"))


_ODD = [("species", "CASE WHEN animal_id % 5 = 0 THEN 'Yak' ELSE species END"),
        ("breed", "CASE WHEN animal_id % 7 = 0 THEN NULL ELSE breed END"),
        ("sex", "sex"), ("health_status", "health_status"),
        ("symptom_1", "CASE WHEN animal_id % 3 = 0 THEN lower(symptom_1) ELSE symptom_1 END"),
        ("symptom_2", "symptom_2")]


@query("pipeline_one_hot", S.with_(S.ANIMAL, _TRAIN, f"""odd AS (SELECT animal_id, {', '.join(f'{e} AS {c}' for c, e in _ODD)} FROM train_f),
vocab AS (SELECT DISTINCT column_name, value FROM ({_stack_sql('train_f', _CATS)}) AS v
          WHERE value IS NOT NULL AND {_HASH.replace('animal_id', 'v.animal_id')} <> 0)""") + f"""
SELECT o.animal_id, o.column_name, CAST(v.value IS NOT NULL AS INT) AS non_zeros
FROM ({_stack_sql('odd', _CATS)}) o LEFT JOIN vocab v ON o.column_name = v.column_name AND o.value = v.value""")
def pipeline_one_hot(spark, sf_dir):
    """Non-zero places of each encoded block: one for a value of the training rows, none for unseen or null."""
    f = ml.hash_split(_features(spark, sf_dir), "animal_id")
    stages = [s for s in ml.feature_stages(clean.NUMERIC_FEATURES, _CATS) if isinstance(s, (StringIndexer, OneHotEncoder))]
    model = Pipeline(stages=stages).fit(f.where(F.col("split") == "train"))
    out = model.transform(f.select("animal_id", *[F.expr(e).alias(c) for c, e in _ODD]))
    blocks = F.array(*[F.struct(F.lit(c).alias("column_name"), F.size(F.filter(vector_to_array(f"{c}__ohe"), lambda x: x != 0)).alias("non_zeros"))
                       for c in _CATS])
    return out.select("animal_id", F.inline(blocks))


# --- model checks: what must hold of any fit, computed from its predictions ---


def _checked(model: ml.FittedClassifier, train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """One row: row counts, predictions outside the training labels, probabilities outside 0..100,
    and whether the model beats the most frequent class of the test rows."""
    pred = model.predict(test, ["animal_id", target])
    if "probability_array" not in pred.columns:
        pred = pred.withColumn("probability_array", F.array(F.lit(0.0)))
    pred = stored(pred, "model-check")
    known = train.select(F.col(target).alias("predicted_label")).distinct()
    outside = pred.join(known, "predicted_label", "left_anti").agg(F.count(F.lit(1))).scalar()
    majority = pred.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    odd = F.sum(F.when(F.forall("probability_array", lambda p: (p >= 0) & (p <= 1)), 0).otherwise(1)).cast("long")
    hits = F.sum(F.when(F.col("predicted_label") == F.col(target), 1).otherwise(0))
    return pred.agg(F.count(F.lit(1)).alias("n_test"), odd.alias("odd_probabilities"), (hits > majority).alias("beats_majority")
                    ).select(train.agg(F.count(F.lit(1))).scalar().alias("n_train"), "n_test", outside.alias("outside_labels"),
                             "odd_probabilities", "beats_majority")


def _check_sql(train: str, test: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {train}) AS n_train, (SELECT count(*) FROM {test}) AS n_test,
 CAST(0 AS BIGINT) AS outside_labels, CAST(0 AS BIGINT) AS odd_probabilities, true AS beats_majority"""


_BY_SPLIT = S.with_(S.ANIMAL, f"s AS (SELECT animal_id, {_SPLIT} AS split FROM animal)")
_HALVES = _check_sql("s WHERE split = 'train'", "s WHERE split = 'test'")


@query("health_status_forest_check", _BY_SPLIT + _HALVES)
def health_status_forest_check(spark, sf_dir):
    """The health forest on a label that its features decide."""
    f = health_frame(spark, sf_dir).withColumn("label_text", F.when(F.col("heart_rate_num") > 85, "Fever").otherwise("Healthy"))
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    model = ml.fit_classifier(train, HEALTH_NUMERIC, [], "label_text", ml.forest("label_idx"), scale=False)
    return _checked(model, train, test, "label_text")


def _feature_check(spark, sf_dir, target: str, label):
    f = ml.hash_split(_features(spark, sf_dir), "animal_id").withColumn(target, label)
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    return _checked(ml.fit_classifier(train, clean.NUMERIC_FEATURES, _CATS, target, ml.forest("label_idx")), train, test, target)


@query("survival_forest_check", _BY_SPLIT + _HALVES)
def survival_forest_check(spark, sf_dir):
    """The survival forest on an outcome that species and heart rate decide."""
    fatal = F.col("species").isin("Cat", "Dog") | (F.col("heart_rate") > 110)
    return _feature_check(spark, sf_dir, "outcome", F.when(fatal, F.lit(FV.OUTCOME_FATAL)).otherwise(F.lit(FV.OUTCOME_LIVE)))


@query("disease_forest_check", _BY_SPLIT + _HALVES)
def disease_forest_check(spark, sf_dir):
    """The disease forest on a disease that the first symptom decides, with a missing class."""
    d = (F.when(F.col("symptom_1") == "Fever", F.lit("Tick Fever")).when(F.col("symptom_1") == "Cough", F.lit(None).cast("string"))
         .otherwise(F.lit("FMD")))
    return _feature_check(spark, sf_dir, "disease", F.coalesce(d, F.lit("nan")))


@query("svm_linear_check", S.with_(S.ANIMAL, _CMP_ID, f"enc AS ({_ENCODED})", f"""s AS (
 SELECT *, {_SPLIT} AS split FROM enc WHERE bp_systolic IS NOT NULL AND bp_diastolic IS NOT NULL)""") + _HALVES)
def svm_linear_check(spark, sf_dir):
    """The linear SVM on a label that is linear in a feature."""
    f = stored(_comparison_split(spark, sf_dir).withColumn("target", F.when(F.col("bp_systolic") > 120, "high").otherwise("low")), "svm-check")
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    return _checked(ml.fit_classifier(train, _SVM_FEATURES, [], "target", ml.linear_svm(), scale=True), train, test, "target")


def _ring():
    return (F.pow((F.col("bp_systolic") - 120) / 20, 2) + F.pow((F.col("bp_diastolic") - 72) / 15, 2)) > 1.2


def _fit_svm(train: DataFrame, rbf: bool) -> ml.FittedClassifier:
    stages = ml.rbf_stages(train, _SVM_FEATURES) if rbf else None
    return ml.fit_classifier(train, _SVM_FEATURES, [], "target", ml.linear_svm(), scale=True, stages=stages)


@query("svm_rbf_check", (S.with_(S.ANIMAL, _CMP_ID, f"enc AS ({_ENCODED})", f"""s AS (
 SELECT *, {_SPLIT} AS split FROM enc WHERE bp_systolic IS NOT NULL AND bp_diastolic IS NOT NULL)""") + _HALVES).replace(
    "true AS beats_majority", "true AS beats_majority, true AS beats_linear, true AS right_in_80_percent"))
def svm_rbf_check(spark, sf_dir):
    """The RBF SVM on a ring-shaped label, which no linear one can tell."""
    f = stored(_comparison_split(spark, sf_dir).withColumn("target", F.when(_ring(), "out").otherwise("in")), "svm-rbf-check")
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    model = _fit_svm(train, True)
    a, b = (ml.accuracy(m.predict(test, ["target"]), "predicted_label", "target").select("accuracy_pct").first()[0] for m in (model, _fit_svm(train, False)))
    return _checked(model, train, test, "target").withColumns({"beats_linear": F.lit(a > b), "right_in_80_percent": F.lit(a >= 80)})


@query("chance_of_living_check", S.with_(S.ANIMAL) + _check_sql("animal", "animal").replace(
    "true AS beats_majority", "true AS lowercase_matters"))
def chance_of_living_check(spark, sf_dir):
    """Both forms of the request scored by one survival model: probabilities, labels and row counts."""
    model = fit_feature_model(spark, sf_dir, "outcome")
    train = _features(spark, sf_dir)
    a, b = (model.predict(intake_forms(spark, sf_dir, low), ["animal_id"]).select(
        "animal_id", "predicted_label", model.class_probability_pct(FV.OUTCOME_LIVE).alias("pct")) for low in (False, True))
    both = stored(a.join(b.select("animal_id", F.col("pct").alias("low_pct")), "animal_id"), "chance-check")
    outside = both.join(train.select(F.col("outcome").alias("predicted_label")).distinct(), "predicted_label", "left_anti").agg(F.count(F.lit(1))).scalar()
    odd = F.sum(F.when(F.col("pct").between(0, 100) & F.col("low_pct").between(0, 100), 0).otherwise(1)).cast("long")
    return both.agg(F.count(F.lit(1)).alias("n_test"), odd.alias("odd_probabilities"), F.max(F.col("pct") != F.col("low_pct")).alias("lowercase_matters")
                    ).select(train.agg(F.count(F.lit(1))).scalar().alias("n_train"), "n_test", outside.alias("outside_labels"), "odd_probabilities", "lowercase_matters")


@query("combined_diagnosis_check", f"SELECT count(*) AS n, CAST(sum(needs_model::INT) AS BIGINT) AS by_model, "
       f"CAST(sum((NOT needs_model)::INT) AS BIGINT) AS by_rule, CAST(0 AS BIGINT) AS unknown_labels FROM ({_DIAG_RULES_SQL}) t")
def combined_diagnosis_check(spark, sf_dir):
    """Rows answered by the model and by the rules, and model answers that are no known status."""
    out = stored(_combined(spark, sf_dir), "diagnosis-check")
    status = F.col("prediction").substr(F.lit(1), F.length("prediction") - len(FV.MODEL_MARK))
    wrong = F.col("needs_model") & ~(F.col("prediction").endswith(FV.MODEL_MARK) & status.isin(*FV.HEALTH_STATUS_CHOICES))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("needs_model").cast("int")).cast("long").alias("by_model"),
                   F.sum((~F.col("needs_model")).cast("int")).cast("long").alias("by_rule"),
                   F.sum(wrong.cast("int")).cast("long").alias("unknown_labels"))


@query("health_model_accuracy")
def health_model_accuracy(spark, sf_dir):
    """M6's accuracy on the held-out rows: (n, correct, accuracy_pct)."""
    test = health_frame(spark, sf_dir).where(F.col("split") == "test")
    pred = fit_health_model(spark, sf_dir).predict(test, ["animal_id", "label_text"])
    return ml.accuracy(pred, "predicted_label", "label_text")


_SVM_FEATURES = ["sex", "age_years", "heart_rate", "disease", "bp_systolic", "bp_diastolic"]


def _comparison_split(spark, sf_dir) -> DataFrame:
    f = filters.drop_null_rows(encoded_comparison_frame(spark, sf_dir))
    f = f.withColumn("target", F.col("health_status").cast("string"))
    f = f.withColumns({c: F.col(c).cast("double") for c in _SVM_FEATURES})
    return ml.hash_split(f, "animal_id")


def _fit_compare(frame: DataFrame, clf):
    model = ml.fit_classifier(frame.where(F.col("split") == "train"), _SVM_FEATURES, [], "target", clf, scale=True)
    return model.predict(frame.where(F.col("split") == "test"), ["animal_id", "target"])


@query("svm_linear")
def svm_linear(spark, sf_dir):
    return _fit_compare(_comparison_split(spark, sf_dir), ml.linear_svm()).select(
        "animal_id", F.col("target").alias("health_status"), "predicted_label")


@query("svm_rbf")
def svm_rbf(spark, sf_dir):
    frame = stored(_comparison_split(spark, sf_dir), "svm-rbf")
    model = _fit_svm(frame.where(F.col("split") == "train"), True)
    return model.predict(frame.where(F.col("split") == "test"), ["animal_id", "target"]).select(
        "animal_id", F.col("target").alias("health_status"), "predicted_label")


def _comparison(frame: DataFrame) -> DataFrame:
    """(model, n, accuracy_pct) of the forest and the SVM on the test rows of one stored frame."""
    rf = ml.accuracy(_fit_compare(frame, ml.forest("label_idx")), "predicted_label", "target")
    train, test = frame.where(F.col("split") == "train"), frame.where(F.col("split") == "test")
    svm = ml.accuracy(_fit_svm(train, True).predict(test, ["animal_id", "target"]), "predicted_label", "target")
    return (rf.select(F.lit("Random Forest").alias("model"), "n", "accuracy_pct")
            .unionByName(svm.select(F.lit("SVM").alias("model"), "n", "accuracy_pct")))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """The encoded frame is stored once for both fits and both predictions."""
    return _comparison(stored(_comparison_split(spark, sf_dir), "comparison")).drop("n")


@query("model_comparison_check", S.with_(S.ANIMAL, _CMP_ID, f"enc AS ({_ENCODED})", f"""s AS (
 SELECT *, {_SPLIT} AS split FROM enc WHERE bp_systolic IS NOT NULL AND bp_diastolic IS NOT NULL)""") + """
SELECT m.model, count(*) AS n, true AS right_in_80_percent FROM s, (VALUES ('Random Forest'), ('SVM')) m(model)
WHERE split = 'test' GROUP BY m.model""")
def model_comparison_check(spark, sf_dir):
    """The comparison on a ring-shaped label, which both models can learn: test rows and known accuracy."""
    f = stored(_comparison_split(spark, sf_dir).withColumn("target", F.when(_ring(), "out").otherwise("in")), "comparison-check")
    return _comparison(f).select("model", "n", (F.col("accuracy_pct") >= 80).alias("right_in_80_percent"))


def _combined(spark, sf_dir) -> DataFrame:
    """Rule part first; rows that need it get the health model's label + model mark."""
    a = views.dirty_animal(spark, sf_dir).where("copy_no = 0").drop("copy_no")
    a = clean.blank_normalise(a, [c for c in a.columns if c != "animal_id"])
    # The rules' expressions are long: each reads plain columns after the exchange, and they run once, on all cores.
    a = a.repartition(3 * spark.sparkContext.defaultParallelism)
    d = rules.combined_diagnosis_rule_part(a).withColumnRenamed("prediction", "rule_prediction")
    d = d.withColumns({
        "bp_num": F.coalesce(to_double(bp_part("bp", 1)), F.lit(0.0)),
        "heart_rate_num": F.coalesce(to_double(filters.alias_value(d, FV.HEART_RATE_NAMES, "0", zero_falls_through=True)), F.lit(0.0)),
        "age_num": F.coalesce(to_double(filters.alias_value(d, FV.AGE_NAMES, "0", zero_falls_through=True)), F.lit(0.0)),
    })
    d = stored(d.select("animal_id", "needs_model", "rule_prediction", *HEALTH_NUMERIC), "diagnosis-rules")
    model = fit_health_model(spark, sf_dir)
    said = F.concat(F.col("predicted_label"), F.lit(FV.MODEL_MARK)).alias("prediction")
    scored = model.predict(d.where("needs_model"), ["animal_id", "needs_model"]).select("animal_id", "needs_model", said)
    return scored.unionByName(d.where("NOT needs_model").select("animal_id", "needs_model", F.col("rule_prediction").alias("prediction")))


@query("combined_diagnosis")
def combined_diagnosis(spark, sf_dir):
    return _combined(spark, sf_dir).drop("needs_model")
