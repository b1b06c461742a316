"""Registered queries: SQL oracle comparison and model sanity on the small tables."""

import pytest
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.plans import check
from herdlens.plans.registry import load_all

from conftest import SF_ORACLE, SF_SMALL

REG = load_all()
SQL_KEYS = sorted(k for k, q in REG.items() if q.sql is not None)
MODEL_KEYS = sorted(k for k, q in REG.items() if q.sql is None)


def test_entry_contract():
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 55


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["animal_id", "disease"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SQL_KEYS)
def test_query_matches_oracle(spark, name):
    q = REG[name]
    sc, sr = check.spark_rows(q.build(spark, SF_ORACLE))
    qc, qr = check.duckdb_frame(SF_ORACLE, q.sql)
    ok, msg = check.compare(sc, sr, qc, qr)
    assert ok, msg


def test_forest_outputs(spark):
    out = REG["survival_forest"].build(spark, SF_SMALL)
    rows = out.collect()
    assert len(rows) == 150
    assert all(0.0 <= r.chance_of_living <= 100.0 for r in rows)
    assert {r.predicted_label for r in rows} <= {FV.OUTCOME_LIVE, FV.OUTCOME_FATAL}


def test_health_model_beats_majority_on_learnable_label(spark):
    from herdlens.operators import ml

    rows = [(i, float(90 + i % 60), float(40 + (i * 13) % 90), float(i % 15)) for i in range(600)]
    df = spark.createDataFrame(rows, "animal_id bigint, bp_num double, heart_rate_num double, age_num double")
    df = df.withColumn("label_text", F.when(F.col("bp_num") > 120, "Sick").otherwise("Healthy"))
    df = ml.hash_split(df, "animal_id")
    model = ml.fit_classifier(df.where("split = 'train'"), ["bp_num", "heart_rate_num", "age_num"], [],
                              "label_text", ml.forest("label_idx", num_trees=20, max_depth=5), scale=False)
    pred = model.predict(df.where("split = 'test'"), ["label_text"])
    acc = ml.accuracy(pred, "predicted_label", "label_text").collect()[0].accuracy_pct
    test = df.where("split = 'test'")
    majority = test.groupBy("label_text").count().agg(F.max("count")).collect()[0][0] / test.count() * 100
    assert acc > majority


def test_model_comparison_rows(spark):
    rows = REG["model_comparison"].build(spark, SF_SMALL).collect()
    assert sorted(r.model for r in rows) == ["Random Forest", "SVM"]
    assert all(0 <= r.accuracy_pct <= 100 for r in rows)


def test_combined_diagnosis_uses_rules_first(spark):
    full = {r.animal_id: r.prediction for r in REG["combined_diagnosis"].build(spark, SF_SMALL).collect()}
    rule = {r.animal_id: (r.prediction, r.needs_model)
            for r in REG["combined_diagnosis_rules"].build(spark, SF_SMALL).collect()}
    assert full.keys() == rule.keys()
    for k, (p, needs) in rule.items():
        if needs:
            assert full[k].endswith(FV.MODEL_MARK)
        else:
            assert full[k] == p
