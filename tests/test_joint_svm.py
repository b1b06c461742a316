"""One-vs-rest SVMs fitted together: as low a loss as MLlib's, one job for a step of all classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.operators import joint_svm, ml

NUMERIC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    f = spark.range(600).select("id", ((i * 7919) % 101 / 10.0).alias("a"), ((i * 104729) % 97 / 7.0).alias("b"), F.lit(3.0).alias("c"))
    return f.withColumn("target", F.when(F.col("a") + F.col("b") + F.sin("id") > 12, "x").when(F.col("a") > 6, "y").otherwise("z"))


def losses(model, rows, weights):
    f = model.features.transform(rows).select("target", "features").collect()
    sign = np.where(np.array([model.labels.index(r.target) for r in f])[:, None] == np.arange(len(weights)), 1.0, -1.0)
    return np.maximum(0, 1 - sign * (np.array([r.features.toArray() for r in f]) @ weights[:, :-1].T + weights[:, -1])).mean(axis=0)


@pytest.mark.parametrize("rbf", [False, True])
def test_joint_fit_is_as_good_as_mllibs(spark, rows, rbf, monkeypatch, tmp_path):
    def fit():
        return ml.fit_classifier(rows, NUMERIC, [], "target", ml.linear_svm(max_iter=15), stages=ml.rbf_stages(rows, NUMERIC, 12) if rbf else None)

    mllib = fit()
    theirs = np.array([[*m.coefficients.toArray(), m.intercept] for m in mllib.model.stages[-1].models])
    passes, sums = [], joint_svm._sums
    monkeypatch.setattr(joint_svm, "_sums", lambda *a: (passes.append(len(a[2])), sums(*a))[1])
    monkeypatch.setattr(ml, "MLLIB_SVM_ROWS", 599)
    model = fit()
    assert isinstance(model, joint_svm.JointSVM) and model.labels == mllib.labels
    assert passes[0] == 3 and len(passes) < sum(passes) / 2  # a pass serves all classes
    assert (losses(model, rows, model.weights) <= 1.05 * losses(model, rows, theirs) + 0.005).all()
    said = {r.id: r.predicted_label for r in model.predict(rows, ["id"]).collect()}
    assert len(said) == 600
    model.save(spark, str(tmp_path))
    again = ml.FittedClassifier.load(spark, str(tmp_path))
    assert {r.id: r.predicted_label for r in again.predict(rows, ["id"]).collect()} == said


def test_other_svms_stay_with_mllib():
    assert joint_svm.JointSVM.fits(ml.linear_svm().getClassifier())
    assert not joint_svm.JointSVM.fits(ml.linear_svm(reg=0.1).getClassifier())


def test_minimum_of_a_kinked_function():
    run, (loss, grad) = joint_svm.minimise(2, 100, 1e-6), (0, 0)
    at = next(run)
    for _ in range(2000):
        loss, grad = abs(at[0] - 3) + (at[1] + 2) ** 2, np.array([np.sign(at[0] - 3), 2 * (at[1] + 2)])
        try:
            at = run.send((float(loss), grad))
        except StopIteration as end:
            assert np.allclose(end.value, [3, -2], atol=0.05)
            return
    pytest.fail("no end")
