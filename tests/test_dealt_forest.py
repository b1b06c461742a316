"""Forests grown over rows dealt to (tree, node): what they learn, their bounds, saving, the stream; MLlib's as a yardstick."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.operators import dealt_forest, ml
from herdlens.plans import check
from herdlens.plans.registry import load_all

from conftest import SF_ORACLE, SF_SMALL


@pytest.fixture
def dealt(monkeypatch):
    """Every forest is dealt, from nodes of 150 rows on, in chunks of 200."""
    monkeypatch.setattr(ml, "MLLIB_FOREST_ROWS", 0)
    monkeypatch.setattr(dealt_forest, "GROUP_ROWS", 150)
    monkeypatch.setattr(dealt_forest, "CHUNK_ROWS", 200)


def _rows(spark, n=1200):
    k = F.col("id")
    return spark.range(n).repartition(3).select(
        k, (F.hash(k) % 100).cast("double").alias("p"), F.when(k % 50 != 0, (F.hash(k, F.lit(1)) % 7).cast("double")).alias("q"),
        F.element_at(F.array(*[F.lit(v) for v in "abcd"]), (k % 4 + 1).cast("int")).alias("c"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), (k % 5).cast("string"))).alias("d"))


def test_learns_what_mllib_learns(spark, dealt, monkeypatch):
    f = _rows(spark).withColumn("y", F.when((F.col("p") > 10) & (F.col("c") != "b"), "up").when(F.col("d") == "s2", "mid"))
    train, test = f.where("id % 5 <> 0"), f.where("id % 5 = 0").withColumn("c", F.when(F.col("id") % 35 == 0, "new").otherwise(F.col("c")))

    def right(model):
        rows = model.predict(test, ["id", "y"]).collect()
        assert len(rows) == 240 and len({r.id for r in rows}) == 240
        assert {r.predicted_label for r in rows} <= {"up", "mid", "nan"}
        assert all(abs(sum(r.probability_array) - 1) < 1e-9 for r in rows)
        return np.mean([r.predicted_label == (r.y or "nan") for r in rows])

    model = ml.fit_classifier(train, ["p", "q"], ["c", "d"], "y", ml.forest("label_idx", num_trees=20))
    assert isinstance(model, dealt_forest.DealtForest)
    assert model.tops.number("leaf") and model.tops.number("dealt") > 20
    monkeypatch.setattr(ml, "MLLIB_FOREST_ROWS", 10_000)
    mllib = ml.fit_classifier(train, ["p", "q"], ["c", "d"], "y", ml.forest("label_idx", num_trees=20))
    assert isinstance(mllib, ml.FittedClassifier)
    assert right(model) >= max(0.9, right(mllib) - 0.05)


def test_undecided_labels_grow_bounded_parts_to_whole_trees(spark, dealt, monkeypatch):
    """A label by chance: every part holds its node's rows only, and all leaves of a tree hold all of its rows."""
    f = _rows(spark).withColumn("y", (F.abs(F.hash("id", F.lit(9))) % 3).cast("string")).withColumn("p", F.rand(3))
    model = ml.fit_classifier(f, ["p", "q"], ["c"], "y", ml.forest("label_idx", num_trees=5))
    held = {t: 0.0 for t in range(5)}
    for r in model.parts.collect():
        n = float(np.frombuffer(r.counts, np.float32).sum())
        assert 0 < n <= 150
        held[r.tree] += n
    for t, top in enumerate(model.tops.trees):
        held[t] += sum(sum(c) for c, s in zip(top["counts"], top["state"]) if s == "leaf")
        assert 1050 < held[t] < 1350  # Poisson(1) copies of 1,200 rows
    a, b = ([(r.id, r.probability_array) for r in model.predict(f.repartition(n), ["id"]).orderBy("id").collect()] for n in (2, 7))
    assert a == b


def test_saved_and_scored_beyond_the_training_rows(spark, dealt, tmp_path):
    f = _rows(spark, 600).withColumn("y", F.when(F.col("c") == "a", "x").otherwise("z"))
    model = ml.fit_classifier(f, ["p"], ["c"], "y", ml.forest("label_idx", num_trees=10))
    model.save(spark, str(tmp_path / "m"))
    again = ml.FittedClassifier.load(spark, str(tmp_path / "m"))
    assert isinstance(again, dealt_forest.DealtForest)
    wide = f.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    want = {(r.id, r.predicted_label, tuple(r.probability_array)) for r in model.predict(f, ["id"]).collect()}
    got = again.predict(wide, ["id", "copy"]).collect()
    assert len(got) == 1800 and {(r.id, r.predicted_label, tuple(r.probability_array)) for r in got} == want


def test_no_more_depth_than_asked(spark, dealt):
    f = _rows(spark, 600).withColumn("y", (F.abs(F.hash("id", F.lit(9))) % 2).cast("string"))
    model = ml.fit_classifier(f, ["p"], [], "y", ml.forest("label_idx", num_trees=4, max_depth=2))
    assert max(d for t in model.tops.trees for d in t["depth"]) <= 2
    for r in model.parts.collect():
        assert len(r.feat) // 4 <= 2 ** (3 - model.tops.trees[r.tree]["depth"][r.node]) - 1


def test_a_part_splits_like_brute_force():
    """All features drawn: the first cut of a part is the one of the greatest Gini gain."""
    rng = np.random.default_rng(5)
    space = dealt_forest.Space(2, [])
    assert space.drawn == 2
    x, y, w = rng.integers(0, 32, (300, 2)), rng.integers(0, 3, 300), rng.integers(1, 4, 300).astype(float)
    feat, thr, child, counts = dealt_forest.grow(space, x, y, w, 3, 1, np.random.default_rng(0))

    def gini(rows):
        c = np.bincount(y[rows], w[rows], 3)
        return c.sum() * (1 - ((c / c.sum()) ** 2).sum()) if c.sum() else 0

    worth = {(f, b): gini(x[:, f] <= b) + gini(x[:, f] > b) for f in range(2) for b in range(31)}
    assert worth[feat[0], thr[0]] == pytest.approx(min(worth.values()))
    assert child.tolist() == [1, -1, -1] and counts[1:].sum() == w.sum()


def test_stream_scores_as_the_batch_does(spark, dealt):
    q = load_all()["stream_intake_scoring"]
    sc, sr = check.spark_rows(q.build(spark, SF_SMALL))
    qc, qr = check.duckdb_frame(SF_SMALL, q.sql)
    ok, msg = check.compare(sc, sr, qc, qr)
    assert ok, msg


def test_check_holds_for_dealt_forests(spark, dealt, monkeypatch):
    monkeypatch.setattr(dealt_forest, "GROUP_ROWS", 1000)
    q = load_all()["chance_of_living_check"]
    sc, sr = check.spark_rows(q.build(spark, SF_ORACLE))
    qc, qr = check.duckdb_frame(SF_ORACLE, q.sql)
    ok, msg = check.compare(sc, sr, qc, qr)
    assert ok, msg


def _kept(monkeypatch):
    """What the forest stores, by purpose."""
    kept, write = {}, dealt_forest.stored
    monkeypatch.setattr(dealt_forest, "stored", lambda df, purpose, *a: kept.setdefault(purpose, write(df, purpose, *a)))
    return kept


def test_distinct_codes_are_scored_in_bounded_chunks(spark, dealt, monkeypatch):
    """Leaves of several classes: votes by brute force, small chunks, and each code vector is dealt once."""
    f = _rows(spark).withColumn("y", (F.abs(F.hash("id", F.lit(9))) % 9).cast("string"))
    model = ml.fit_classifier(f, ["p", "q"], ["c"], "y", ml.forest("label_idx", num_trees=6, max_depth=5))
    monkeypatch.setattr(dealt_forest, "VOTE_BYTES", 60 * 6 * (8 + 12 * 9))
    kept = _kept(monkeypatch)
    rows = model.predict(f.union(f), ["id"]).collect()
    assert len(rows) == 2400
    dealt_rows = kept["forest-dealt"].where("tree = -1").collect()
    distinct = kept["forest-scored"].select("x0", "x1", "x2").distinct().count()
    assert sum(len(r.rows) // 8 for r in dealt_rows) == distinct < 1200
    assert len(dealt_rows) > 2 and max(len(r.rows) // 8 for r in dealt_rows) < 120

    coded = kept["forest-scored"].select("record.id", "x0", "x1", "x2").toPandas().drop_duplicates()
    x, votes = coded[["x0", "x1", "x2"]].to_numpy(model.space.dtype), 0
    parts = {(r.tree, r.node): r for r in model.parts.collect()}
    for t, (top, arrays) in enumerate(zip(model.tops.trees, model.tops.arrays())):
        counts = np.zeros((len(x), 9))
        for i, node in enumerate(dealt_forest.walk(model.space, x, *arrays)):
            counts[i] = top["counts"][node] or 0
            if (t, node) in parts:
                feat, thr, child = (np.frombuffer(parts[t, node][c], np.int32).astype(np.int64) for c in ("feat", "thr", "child"))
                at = (np.cumsum(child < 0) - 1)[dealt_forest.walk(model.space, x[i:i + 1], feat, thr, child)]
                counts[i] = np.frombuffer(parts[t, node].counts, np.float32).reshape(-1, 9)[at[0]]
        votes = votes + counts / counts.sum(axis=1, keepdims=True)
    want = dict(zip(coded["id"], votes / votes.sum(axis=1, keepdims=True)))
    assert all(np.allclose(r.probability_array, want[r.id], atol=1e-12) for r in rows)
    assert {r.predicted_label for r in rows} <= set(model.labels)


def test_a_part_that_many_vectors_fall_into_is_met_in_groups(spark, dealt, monkeypatch):
    f = _rows(spark, 600).withColumn("y", F.when(F.col("p") > 0, F.col("d")).otherwise("z"))
    model = ml.fit_classifier(f, ["p", "q"], ["c"], "y", ml.forest("label_idx", num_trees=3))
    want = {r.id: (r.predicted_label, r.probability_array) for r in model.predict(f, ["id"]).collect()}
    monkeypatch.setattr(dealt_forest, "GROUP_ROWS", 10)
    monkeypatch.setattr(dealt_forest, "CHUNK_ROWS", 7)
    assert {r.id: (r.predicted_label, r.probability_array) for r in model.predict(f, ["id"]).collect()} == want


def test_diagnosis_rules_run_once(spark, dealt, monkeypatch):
    """The model's rows and the rules' rows both come from one stored result of the rules."""
    from herdlens.plans import q_ml

    monkeypatch.setattr(dealt_forest, "GROUP_ROWS", 5000)
    out = q_ml._combined(spark, SF_SMALL)
    assert not [f for f in out.inputFiles() if "customer" in f]
    sc, sr = check.spark_rows(load_all()["combined_diagnosis_check"].build(spark, SF_SMALL))
    qc, qr = check.duckdb_frame(SF_SMALL, load_all()["combined_diagnosis_check"].sql)
    ok, msg = check.compare(sc, sr, qc, qr)
    assert ok, msg


def test_fit_keeps_used_columns_until_rows_are_coded(spark, dealt, monkeypatch):
    seen, fit = {}, dealt_forest.DealtForest.fit

    def spied(train, *a, **k):
        seen["columns"] = set(train.columns)
        model = fit(train, *a, **k)
        seen["kept"] = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
        return model

    monkeypatch.setattr(ml.DealtForest, "fit", staticmethod(spied))
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    f = _rows(spark, 600).withColumn("y", F.when(F.col("c") == "a", "x").otherwise("z")).withColumn("unused", F.lit("long text"))
    ml.fit_classifier(f, ["p"], ["c"], "y", ml.forest("label_idx", num_trees=3))
    assert seen == {"columns": {"p", "c", "y", "label_idx"}, "kept": before}


def test_rows_of_equal_codes_weigh_as_many(spark, dealt, monkeypatch):
    """Rows of the same codes and label become one, which weighs as many as all copies of them, also above a byte."""
    x, y = np.random.default_rng(1).integers(0, 3, (500, 2)).astype(np.uint8), np.arange(500) % 2
    codes, label, same = dealt_forest._cells(x, y)
    assert len(codes) == len(label) == 18 and (codes[same] == x).all() and (label[same] == y).all()
    monkeypatch.setattr(dealt_forest, "CHUNK_ROWS", 2000)
    monkeypatch.setattr(dealt_forest, "GROUP_ROWS", 10_000)
    f = spark.range(3000).select("id", F.lit(1.0).alias("p"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    model = ml.fit_classifier(f, ["p"], [], "y", ml.forest("label_idx", num_trees=4))
    for r in model.parts.collect():
        a, b = np.frombuffer(r.counts, np.float32)
        assert 800 < a < 1200 and 1800 < b < 2200
    assert {r.predicted_label for r in model.predict(f, ["id"]).collect()} == {"b"}
