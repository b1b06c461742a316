"""Split CSV scan, mergeable medians and the scan stream against plain versions of themselves."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import clean, sketches
from herdlens.sources import records, split_csv
from herdlens.sources.tables import scratch_path
from herdlens.streaming import scan_lookup


def _rows(df):
    return sorted(df.collect(), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_split_csv_equals_python_csv_over_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(5)
    parts = ['a', ' b ', '"', '\n', ',', '\r\n', 'é', '""', '']
    want = []
    for name in ("one.csv", "two.csv"):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if name == "two.csv" else "\n")
        w.writerow(["k", "text", "last"])
        for i in range(120):
            # Some values are longer than several splits, with every line break in quotes.
            text = "".join(rng.choices(parts, k=400 if i % 40 == 7 else rng.randrange(8)))
            w.writerow([f"{name}{i}", text, "z"])
            want.append((f"{name}{i}", text or None, "z"))
            if i % 30 == 0:
                out.write("\n")  # an empty line is no record
        (tmp_path / name).write_bytes(out.getvalue().encode())
    got = records.read_records_csv(spark, str(tmp_path), names={}, parallel=True, na_tokens=())
    splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert splits > 20
    assert _rows(got) == sorted(want)
    # The one-task reader makes the quoted line breaks of a CRLF file bare ones.
    one_task = records.read_records_csv(spark, str(tmp_path), names={}, na_tokens=())
    same = F.regexp_replace("text", "\r\n", "\n").alias("text")
    assert _rows(got.select("k", same, "last")) == _rows(one_task.select("k", same, "last"))


def test_split_csv_exchanges_each_line_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"x\ny"\n')
    lines = []
    plain = split_csv.stored
    split_csv.stored = lambda df, purpose: lines.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, purpose)
    try:
        got = split_csv.quoted_records(spark, str(tmp_path))
    finally:
        split_csv.stored = plain
    assert [r.text for r in _rows(got.select("text"))] == ['1,"x\ny"', "k,t"]
    assert "BatchEvalPython" not in lines[0] and "InArrow" not in lines[0]
    # Lines move by split, with the splits' counts beside them; neither window nor grouping moves them again.
    assert lines[0].count("value#") and sum("Exchange hashpartitioning(file" in x and "ENSURE" in x for x in lines[0].splitlines()) <= 3


def test_split_csv_deals_out_runs_of_lines_not_whole_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "CHUNK_LINES", 3)
    out, want = io.StringIO(), []
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["k", "te\n\n\n\n\nxt"])  # a header longer than a chunk
    for i in range(40):
        want.append((str(i), "\n".join(["a", 'b"', ""] * (9 if i % 7 == 3 else i % 3)) or None))
        w.writerow(want[-1])
    for name in ("one.csv", "two.csv"):  # small files share a task, so a file's first line may end a count
        (tmp_path / name).write_text(out.getvalue())
    got = split_csv.quoted_records(spark, str(tmp_path))
    assert got.groupBy("file", "block", "chunk").count().agg(F.max("count")).first()[0] <= 3
    assert got.where("heads").count() == 2
    back = split_csv.read_split_csv(spark, str(tmp_path), ["k", "t"], {"escape": '"'})
    assert _rows(back) == sorted(2 * want, key=lambda r: [(x is not None, str(x)) for x in r])


def test_split_csv_edges(spark, tmp_path):
    def read(text, name):
        p = tmp_path / f"{name}.csv"
        p.write_text(text)
        return records.read_records_csv(spark, str(p), names={}, parallel=True)

    assert read("k,t\n", "header").collect() == []
    assert read("k,t\n1,a", "unended").collect() == [("1", "a")]
    assert _rows(read("k,t\n1\n2,b,c\n", "ragged")) == [("1", None), ("2", "b")]
    with pytest.raises(Exception, match="quotes don't pair up"):
        read('k,t\n1,"a\n2,b\n', "open").collect()


def test_sketched_medians_near_exact_and_merge(spark):
    rows = spark.range(200_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 3 == 1, F.lit(float("nan"))).alias("hot"),
        F.lit(None).cast("double").alias("none"), (F.col("id") % 16).alias("part"))
    cols = ["a", "hot", "none"]
    one = clean.medians_of(rows, cols, "sketch")
    parts = sketches.sketched(rows, cols, ["part"])
    got = {r.column_name: r for r in sketches.quantiles(parts, cols).collect()}
    assert one["hot"] == got["hot"].quantile == 5.0 and one["none"] is None and got["none"].quantile is None
    assert got["a"].n == 200_000 and got["hot"].n == 66_667 and got["none"].n == 0
    for m in (one["a"], got["a"].quantile):
        share = rows.select(F.avg((F.col("a") <= m).cast("int"))).first()[0]
        assert abs(share - 0.5) <= sketches.RANK_ERROR
    assert clean.medians_of(rows.limit(0), cols, "sketch") == dict.fromkeys(cols)


def test_median_stream_sketches_new_files_only(spark):
    src, out, ckpt = (scratch_path(spark, p) for p in ("m-src", "m-out", "m-ckpt"))
    schema = spark.createDataFrame([], "v double").schema

    def more(values):
        spark.createDataFrame([(float(v),) for v in values], schema).coalesce(1).write.mode("append").parquet(src)
        sketches.run_sketch_stream(spark, src, schema, lambda d: d, ["v"], out, ckpt, 1)
        return sketches.read_sketches(spark, out)

    first = more(range(101))
    assert sketches.medians(first, ["v"]) == {"v": 50.0} and first.count() == 1
    second = more(range(101, 201))
    assert sketches.medians(second, ["v"]) == {"v": 100.0} and second.count() == 2
    # Nothing new: nothing sketched again.
    sketches.run_sketch_stream(spark, src, schema, lambda d: d, ["v"], out, ckpt, 1)
    assert sketches.read_sketches(spark, out).count() == 2


def test_large_value_sets_take_the_partition_path(spark, monkeypatch):
    rows = spark.range(3001).select((F.col("id") * 2.0).alias("a"), F.when(F.col("id") < 4, F.col("id") * 1.0).alias("b"))
    want = {"a": 3000.0, "b": 1.5}
    assert clean.medians_of(rows, ["a", "b"]) == want
    monkeypatch.setattr(clean, "SMALL_PAIRS", 10)
    assert clean.medians_of(rows, ["a", "b"]) == want


def test_scan_stream_hot_ids_restart_and_both_sinks(spark):
    rec = spark.createDataFrame([(1, "first", 0), (1, "second", 1), (2, "two", 2), (None, "no id", 3)], "animal_id long, name string, _input_order int")
    src, found, missing, ckpt = (scratch_path(spark, p) for p in ("s-src", "s-found", "s-missing", "s-ckpt"))
    schema = spark.createDataFrame([], "scan_id long, scanned_text string").schema

    def push(rows):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        scan_lookup.run_scan_stream(spark, src, schema, rec, "animal_id", found, missing, ckpt, files_per_trigger=2)

    push([(i, "id 1 of 9") for i in range(50)] + [(100, "2"), (101, "none"), (102, None), (103, "77")])
    push([(200, "2"), (201, "x5x")])
    hits = {r.scan_id: r.name for r in spark.read.parquet(found).collect()}
    assert hits == {**{i: "first" for i in range(50)}, 100: "two", 200: "two"}
    assert spark.read.parquet(found).count() == 52
    why = {r.scan_id: r.message for r in spark.read.parquet(missing).collect()}
    assert why == {101: FV.NO_ID_STATUS, 102: FV.NO_ID_STATUS, 103: "No record found for Animal ID 77", 201: "No record found for Animal ID 5"}


def test_records_of_a_scan_stream_are_neither_broadcast_nor_copied(spark):
    first = spark.createDataFrame([(1, "one"), (2, "two")], "animal_id long, name string")
    scans = spark.createDataFrame([(i, "id 1") for i in range(20)] + [(50, "9"), (51, None)], "scan_id long, scanned_text string")
    out = scan_lookup.match_scans(scans, first, "animal_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert {r.scan_id: r.name for r in out.collect()} == {**{i: "one" for i in range(20)}, 50: None, 51: None}


def test_label_codes_of_many_columns_share_one_ranking(spark):
    from herdlens.operators import ml

    df = spark.createDataFrame([("b", None), ("a", "z"), (None, "y"), ("a", "y")], "p string, q string").withColumn("i", F.monotonically_increasing_id())
    got = ml.label_encode(df, ["p", "q"]).orderBy("i").select("p", "q").collect()
    # Sorted values: p = a, b, nan; q = nan, y, z.
    assert [tuple(r) for r in got] == [(1, 0), (0, 2), (2, 1), (0, 1)]
    assert ml.label_encode(df.limit(0), ["p"]).count() == 0
