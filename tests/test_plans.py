"""Physical-plan properties that matter at scale."""

from herdlens.plans.registry import load_all

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_scoring_is_narrow_and_pruned(spark):
    reg = load_all()
    for name in ["keyword_top1", "keyword_scores", "first_match_label", "keyword_top1_documents"]:
        plan = _plan(reg[name].build(spark, SF_SMALL))
        assert "Exchange" not in plan, name
        for op in ("HashJoin", "SortMergeJoin", "NestedLoopJoin", "CartesianProduct"):
            assert op not in plan, (name, op)


def test_scan_reads_only_used_columns(spark):
    df = load_all()["keyword_top1"].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "c_acctbal" not in plan


def test_median_uses_no_cross_join(spark):
    plan = _plan(load_all()["median_impute"].build(spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_last_n_per_key_is_one_limited_exchange(spark):
    from herdlens.operators import updates

    changes = spark.range(1000).selectExpr("id % 10 as k", "id as ts", "id as seq", "'x' as text")
    for n in (1, 3, 6):
        plan = _plan(updates.top_n_per_key(changes, "k", ["ts", "seq"], ["text"], n))
        assert plan.count("Range (") == 1 and plan.count("Exchange") == 1, plan
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_edit_has_no_window(spark):
    plan = _plan(load_all()["record_update_merge"].build(spark, SF_SMALL))
    assert "Window" not in plan


def test_merge_into_a_bucketed_table_moves_only_the_changes(spark):
    import uuid

    from herdlens.operators import updates
    from herdlens.sources import records, views
    from herdlens.sources.tables import scratch_path

    name = f"bt_{uuid.uuid4().hex}"
    records.save_table(views.dirty_animal(spark, SF_SMALL, input_order=True).drop("vaccination_1"), name, buckets=8, path=scratch_path(spark, "bt"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = updates.record_update_merge(records.current_table(spark, name), views.record_updates(spark, SF_SMALL))
        df.collect()
        lines = _plan(df).split("== Initial Plan ==")[0].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*|"))

    scans = [i for i, x in enumerate(lines) if "FileScan" in x and name in x]
    assert len(scans) == 2
    for i in scans:
        least = depth(lines[i])
        for x in reversed(lines[:i]):  # the line of ancestors
            if depth(x) < least:
                least = depth(x)
                assert "Exchange" not in x, x
