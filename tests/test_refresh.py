"""Views kept up to date by differences equal views made anew."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from herdlens.operators import updates
from herdlens.operators.refresh import BATCH, PART, RefreshedViews, parts_for, view_changes
from herdlens.sources.tables import passing_scratch, scratch_path, stored

SCHEMA = ("animal_id long, name string, symptom_1 string, symptom_2 string, doctor_suggestion string, special_care string, "
          "vaccination_1 string, vaccination_2 string, _input_order long")
EDITS = "animal_id long, ts long, seq long, symptom_1 string, symptom_2 string, suggestion string, special_care string"
ENTRIES = "animal_id long, ts long, seq long, text string"
VIEWS = {"care": lambda r: r.where("lower(special_care) = 'yes'").select("animal_id", "name"),
         "lines": lambda r: r.select("animal_id", F.explode(F.array("symptom_1", "vaccination_1", "vaccination_2")).alias("text")),
         "by_symptom": lambda r: r.select("symptom_1")}


def bag(df):
    return Counter(map(tuple, df.collect()))


def table(spark, n=40):
    rows = [(i % 30 if i % 13 else None, None if i % 7 == 0 else f"n{i}", "Cough", None, "", "", "Old" if i % 3 else None, "", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, seed, keys):
    rng = random.Random(seed)
    edits = [(rng.choice(keys), seed * 100 + i, i, rng.choice([" Fever ", "Cough", None]), "", "rest", rng.choice(["on", None, ""])) for i in range(12)]
    entries = [(rng.choice(keys), seed * 100 + i, i, f"shot {seed}.{i}") for i in range(9)]
    return spark.createDataFrame(edits, EDITS), spark.createDataFrame(entries, ENTRIES)


@pytest.fixture()
def kept(spark, tmp_path):
    base = table(spark)
    kept = RefreshedViews(spark, str(tmp_path / "kept"), base.schema, VIEWS, parts=8)
    kept.load(base)
    return kept


def test_refresh_equals_rebuild_after_every_batch(spark, kept, tmp_path):
    full = table(spark)
    # One hot key, keys without a record, null keys; the third batch is empty.
    for batch, keys in enumerate([[3] * 20 + [4, 5, 99, None], [3, 7, 11, 99], None, list(range(30))], 1):
        edits, entries = changes(spark, batch, keys or [1])
        if keys is None:
            edits, entries = edits.limit(0), entries.limit(0)
        kept.refresh(batch, edits, entries)
        known = [e.where("animal_id IS NOT NULL") for e in (edits, entries)]
        full = spark.createDataFrame(updates.apply_changes(full, *known).collect(), SCHEMA)
        for name, view in kept.views.items():
            assert bag(kept.rows(name)) == bag(view(full)), (batch, name)
    small = kept.compact(str(tmp_path / "small"))
    edits, entries = changes(spark, 9, [3, 4])
    small.refresh(1, edits, entries)
    full = updates.apply_changes(full, edits, entries)
    for name, view in small.views.items():
        assert bag(small.rows(name)) == bag(view(full)), name


def test_passing_scratch_is_gone_and_the_rest_stays(spark):
    stays = stored(spark.range(3), "stays")
    out = scratch_path(spark, "result")
    with passing_scratch():
        gone = stored(stays.where("id > 0"), "gone")
        path = gone.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
        gone.write.parquet(out)
    assert not os.path.exists(path)
    assert stays.count() == 3 and spark.read.parquet(out).count() == 2


def test_a_batch_run_again_changes_nothing(spark, kept):
    batches = [changes(spark, b, list(range(12))) for b in (1, 2)]
    for b, c in enumerate(batches, 1):
        kept.refresh(b, *c)
    once = {n: bag(kept.rows(n)) for n in kept.views}
    kept.refresh(2, *batches[1])
    assert {n: bag(kept.rows(n)) for n in kept.views} == once
    with pytest.raises(ValueError):
        kept.refresh(0, *batches[0])


def test_a_batch_reads_the_parts_of_its_keys_alone(spark, kept):
    key = spark.createDataFrame([(3,), (3,), (None,)], "animal_id long")
    before = kept.before(1, key)
    assert {r.animal_id for r in before.collect()} == {3}
    plan = before._jdf.queryExecution().executedPlan().toString()
    part = spark.range(1).select(F.lit(3).cast("long").alias("animal_id")).select(kept._part("animal_id")).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*{PART}#\d+ = {part}\b", plan), plan
    assert re.search(rf"PartitionFilters: \[[^\]]*{BATCH}#\d+ < 1", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_rows_that_stay_the_same_are_not_written(spark):
    before = table(spark)
    after = before.withColumn("symptom_1", F.when(F.col("_input_order") == 5, F.lit("Fever")).otherwise(F.col("symptom_1")))
    got = Counter({(r.symptom_1): r._copies for r in view_changes(before, after, VIEWS["by_symptom"]).collect()})
    assert got == {"Cough": -1, "Fever": 1}


def test_rows_of_a_scan_are_dealt_out_before_they_are_summed_up(spark, kept):
    for name in ("records", "lines"):
        plan = kept.bag(name)._jdf.queryExecution().executedPlan().toString()
        # From the scan upwards: the exchange comes before the first aggregate, and is the only one.
        assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange"), plan
    # The load writes a keyed row as it is: no sum, so two equal rows are two.
    base = table(spark).where("animal_id = 3").drop("_input_order").withColumn("_input_order", F.lit(0).cast("long"))
    kept.load(base.unionByName(base))
    assert kept._signed("records").count() == 2 * base.count() and bag(kept.rows("records")) == bag(base.unionByName(base))


def test_parts_grow_with_the_records(spark):
    assert [parts_for(spark.range(n), rows_per_part=10, most=20) for n in (0, 80, 81, 1000)] == [8, 8, 9, 20]
    assert parts_for(spark.range(900_000)) == 18


def test_refresh_of_nothing(spark, tmp_path):
    base = table(spark).limit(0)
    kept = RefreshedViews(spark, str(tmp_path / "none"), base.schema, VIEWS, parts=2)
    kept.load(base)
    kept.refresh(1, *changes(spark, 1, [1, None]))
    assert all(kept.rows(n).count() == 0 for n in kept.views)
