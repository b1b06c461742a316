"""Hand-made edge rows (FIXTURES.md section 4) through the operators."""

from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import clean, filters, ml, reports, rules, updates

REC_COLS = ["animal_id", "name", "species", "breed", "sex", "age_years", "bp", "heart_rate",
            "health_status", "symptom_1", "symptom_2", "disease"]


def records(spark, rows):
    return spark.createDataFrame([Row(**{c: r.get(c) for c in REC_COLS}) for r in rows],
                                 "animal_id bigint, name string, species string, breed string, sex string, "
                                 "age_years string, bp string, heart_rate string, health_status string, "
                                 "symptom_1 string, symptom_2 string, disease string")


def test_blank_bp_with_matching_symptom_is_parse_error(spark):
    df = records(spark, [dict(animal_id=1, bp="", symptom_1="fever", heart_rate="70", age_years="3")])
    df = clean.blank_normalise(df, [c for c in REC_COLS if c != "animal_id"])
    out = rules.combined_diagnosis_rule_part(df).collect()[0]
    assert out.prediction == FV.PARSE_ERROR_LABEL and out.needs_model is False


def test_rule_hit_and_model_fallback(spark):
    df = records(spark, [dict(animal_id=1, bp="120/80", symptom_1="Wound on leg", heart_rate="", age_years="2"),
                         dict(animal_id=2, bp="120/80", symptom_1="limping", heart_rate="70", age_years="2"),
                         dict(animal_id=3, bp="120/80", symptom_1="x", heart_rate="abc", age_years="2")])
    df = clean.blank_normalise(df, [c for c in REC_COLS if c != "animal_id"])
    got = {r.animal_id: (r.prediction, r.needs_model)
           for r in rules.combined_diagnosis_rule_part(df).collect()}
    assert got[1] == ("Skin Infection" + FV.RULE_MARK, False)
    assert got[2] == (None, True)
    assert got[3] == (FV.PARSE_ERROR_LABEL, False)


def test_three_part_bp_training_and_intake(spark):
    df = records(spark, [dict(animal_id=1, bp="120/80/3"), dict(animal_id=2, bp="120/x"),
                         dict(animal_id=3, bp="100/60"), dict(animal_id=4, bp="110/70")])
    split = {r.animal_id: (r.bp_systolic, r.bp_diastolic) for r in clean.bp_split(df).collect()}
    assert split[1] == (120.0, 80.0)
    assert split[2] == (120.0, None)
    train = clean.bp_split(df).withColumn("heart_rate", F.lit(70.0))
    train = clean.constant_fill(train, numeric=["bp_systolic", "bp_diastolic"])
    intake = clean.intake_impute(df.withColumn("heart_rate", F.lit("72.5")), train)
    got = {r.animal_id: (r.bp_systolic_in, r.bp_diastolic_in, r.heart_rate_in) for r in intake.collect()}
    # medians of systolic [120,120,100,110] = 115, diastolic [80,0,60,70] = 65; 72.5 is not an int
    assert got[1] == (115, 65, 70)
    assert got[2] == (115, 65, 70)
    assert got[3] == (100, 60, 70)


def test_systolic_parse_keeps_missing_apart_from_error(spark):
    df = records(spark, [dict(animal_id=1, bp=None), dict(animal_id=2, bp="abc/1"),
                         dict(animal_id=3, bp="12d/1"), dict(animal_id=4, bp=" 130 /85")])
    got = {r.animal_id: r.bp_num for r in clean.bp_systolic_num(df).collect()}
    assert got == {1: None, 2: 0.0, 3: 0.0, 4: 130.0}


def test_tie_goes_to_earliest_rule_and_keyword_inside_keyword(spark):
    df = records(spark, [dict(animal_id=1, symptom_1="fever", symptom_2=None),
                         dict(animal_id=2, symptom_1="high fever", symptom_2=None),
                         dict(animal_id=3, symptom_1="limping", symptom_2="")])
    got = {r.animal_id: r.disease for r in
           rules.keyword_top1(df, ["symptom_1", "symptom_2"]).collect()}
    assert got[1] == "viral infection "
    # "high fever" also contains "fever": viral infection, hemorrhagic septicemia and
    # tick fever all score 1, so the earliest rule wins
    assert got[2] == "viral infection "
    scores = {r.ord: r.score for r in rules.keyword_scores(
        df.where("animal_id = 2"), ["animal_id"], ["symptom_1", "symptom_2"]).collect()}
    assert scores[1] == 1 and scores[14] == 1 and scores[18] == 1
    assert got[3] == FV.NO_MATCH_LABEL


def test_same_keyword_in_both_symptoms_each_vs_any(spark):
    df = records(spark, [dict(animal_id=1, symptom_1="cough", symptom_2="Cough")])
    each = rules.keyword_scores(df, ["animal_id"], ["symptom_1", "symptom_2"], mode="each")
    anyk = rules.keyword_scores(df, ["animal_id"], ["symptom_1", "symptom_2"], rules.DISEASES_6, mode="any")
    assert each.where("ord = 1").collect()[0].score == 2
    assert anyk.where("ord = 1").collect()[0].score == 1


def test_null_disease_lives(spark):
    df = records(spark, [dict(animal_id=1, disease=None), dict(animal_id=2, disease="Rabies")])
    got = {r.animal_id: r.outcome for r in clean.outcome_label(df).collect()}
    assert got == {1: FV.OUTCOME_LIVE, 2: FV.OUTCOME_FATAL}


def test_unseen_category_has_no_one_hot_row(spark):
    train = records(spark, [dict(animal_id=1, species="Cow"), dict(animal_id=2, species="Dog")])
    score = records(spark, [dict(animal_id=3, species="Yak"), dict(animal_id=4, species="Cow")])
    got = ml.one_hot_long(score, ["animal_id"], ["species"], train).collect()
    assert [(r.animal_id, r.category) for r in got] == [(4, "Cow")]


def test_duplicate_id_only_first_row_updated_and_looked_up(spark):
    base = spark.createDataFrame(
        [(7, "first", 0), (7, "second", 1), (8, "other", 2)],
        "animal_id bigint, name string, pos int").withColumn(
        "_input_order", F.struct(F.lit("f").alias("f"), F.col("pos").cast("bigint").alias("r")))
    base = base.withColumns({"symptom_1": F.lit("a"), "symptom_2": F.lit("b")})
    ups = spark.createDataFrame(
        [(7, datetime(2024, 1, 1), 1, " Fever ", "", "  note ", None),
         (7, datetime(2024, 1, 2), 2, "Cough", "", "", "on"),
         (9, datetime(2024, 1, 1), 3, "x", "y", "z", "on")],
        "animal_id bigint, ts timestamp, seq bigint, symptom_1 string, symptom_2 string, "
        "suggestion string, special_care string")
    out = updates.record_update_merge(base, ups).orderBy("pos").collect()
    assert [(r.name, r.symptom_1, r.symptom_2, r.doctor_suggestion, r.special_care) for r in out] == [
        ("first", "Cough", "", "", "Yes"), ("second", "a", "b", "", ""), ("other", "a", "b", "", "")]
    req = spark.createDataFrame([("7",), ("9",)], "rid string")
    hits = filters.lookup(req, "rid", base.select("animal_id", "name", "_input_order"), "animal_id").collect()
    assert [(h.rid, h.name) for h in hits] == [("7", "first")]
    miss = filters.lookup_missing(req, "rid", base, "animal_id").collect()
    assert [m.message for m in miss] == ["No record found for Animal ID 9"]


def test_first_vaccination_and_push(spark):
    base = spark.createDataFrame([(1, 0), (2, 1)], "animal_id bigint, pos int").withColumn(
        "_input_order", F.struct(F.lit("f").alias("f"), F.col("pos").cast("bigint").alias("r")))
    entries = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 1, "FMD (2024-01-01)"),
         (1, datetime(2024, 3, 1), 2, "HS (2024-03-01)"),
         (1, datetime(2024, 2, 1), 3, "BQ (2024-02-01)"),
         (2, datetime(2024, 1, 1), 4, "Rabies (2024-01-01)")],
        "animal_id bigint, ts timestamp, seq bigint, text string")
    got = {r.animal_id: (r.vaccination_1, r.vaccination_2)
           for r in updates.vaccination_push(base, entries).collect()}
    assert got == {1: ("HS (2024-03-01)", "BQ (2024-02-01)"), 2: ("Rabies (2024-01-01)", "")}


def test_blank_vaccine_rejected(spark):
    df = spark.createDataFrame([(1, "  ", "2024-01-01"), (2, "FMD", " "), (3, "FMD", "2024-01-01")],
                               "animal_id bigint, vaccine string, vaccine_date string")
    got = {r.animal_id: (r.accepted, r.reason) for r in
           filters.validate_required(df, ["animal_id", "vaccine", "vaccine_date"]).collect()}
    assert got == {1: (False, "Missing data"), 2: (False, "Missing data"), 3: (True, None)}


def test_scan_without_digits(spark):
    df = spark.createDataFrame([("abc",), ("id-0042x7",)], "t string")
    got = [r.i for r in df.select(filters.extract_id("t").alias("i")).collect()]
    assert got == [None, "0042"]


def test_report_lines_and_absent_slots(spark):
    df = records(spark, [dict(animal_id=1, name="Bo", symptom_1="Fever", symptom_2=None, disease="FMD")])
    rep = {r.line_no: (r.label, r.text) for r in reports.animal_report(df, accuracy_pct=87.5).collect()}
    assert len(rep) == 13
    assert rep[7] == ("Symptoms", "Fever")
    assert rep[8] == ("Detected Disease", "FMD")
    assert rep[9] == ("Model Accuracy", "87.5%")
    card = reports.record_card(df).collect()[0]
    assert card.vaccination_1 == FV.ABSENT_SLOT and card.special_star is False


def test_python_strip_whitespace(spark):
    from herdlens.functions.text import py_strip
    df = spark.createDataFrame([("　\t x y  \n",)], "s string")
    assert df.select(py_strip("s").alias("s")).collect()[0].s == "x y"


def test_rules_as_data_of_any_size(spark):
    rows = [(i, f"rule {i}", f"word{i} ") for i in range(1, 7000)] + [(7001, "none", None)]
    table = rules.rules_from_df(spark.createDataFrame(rows, "ord int, disease string, kw string"))
    df = spark.createDataFrame([(1, "has word6500 in it", "word6500 word12 x"), (2, "", None)], "id int, a string, b string")
    got = {r.id: r.disease for r in rules.keyword_top1(df, ["a", "b"], table, fallback="-").select("id", "disease").collect()}
    assert got == {1: "rule 6500", 2: "-"}


def test_rule_without_keywords_scores_zero(spark):
    table = rules.KeywordTable.of([("empty", []), ("x", ["x"])], "none")
    df = spark.createDataFrame([(1, "xx", "x"), (2, "a", "b")], "id int, a string, b string")
    got = [(r.id, r.disease, r.score) for r in rules.keyword_scores(df, ["id"], ["a", "b"], table).orderBy("id", "ord").collect()]
    assert got == [(1, "empty", 0), (1, "x", 2), (2, "empty", 0), (2, "x", 0)]
    assert [r.disease for r in rules.keyword_top1(df, ["a", "b"], table).orderBy("id").collect()] == ["x", "none"]


def test_streamed_vaccination_state_equals_batch(spark):
    from herdlens.plans.registry import load_all
    from conftest import SF_SMALL

    reg = load_all()
    for stream, batch in (("stream_vaccination_state", "vaccination_push"), ("stream_record_state", "record_update_merge")):
        a = {tuple(r) for r in reg[stream].build(spark, SF_SMALL).collect()}
        b = {tuple(r) for r in reg[batch].build(spark, SF_SMALL).collect()}
        assert a == b and len(a) == 153


def test_vaccination_state_goes_on_after_a_restart(spark):
    from herdlens.sources.tables import scratch_path
    from herdlens.streaming import vaccination_state as V

    schema = spark.createDataFrame([], "animal_id bigint, ts timestamp, seq bigint, vaccine string, vaccine_date string").schema
    known = spark.createDataFrame([(1,), (2,), (2,)], "animal_id bigint")
    src, ckpt = scratch_path(spark, "state-src"), scratch_path(spark, "state-ckpt")
    for n in (3, 1, 2):  # late files; each run takes up the state of the last from the checkpoint
        rows = [(1, datetime(2024, n, 1), n, f"v{n}", "d"), (1, datetime(2024, n, 1), n, f"v{n}", "d"),
                (2, datetime(2024, 1, 1), 10 + n, " ", "d"), (3, datetime(2024, 1, 1), 9, "x", "d")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        V.run_vaccination_stream(spark, src, schema, known, ckpt)
    state = V.read_vaccination_state(spark, ckpt)
    assert sorted((r.animal_id, r.seq, r.text) for r in state.collect()) == [(1, 2, "v2 (d)"), (1, 3, "v3 (d)")]


def test_edit_state_keeps_the_newest_after_a_restart(spark):
    from herdlens.sources.tables import scratch_path
    from herdlens.streaming import vaccination_state as V

    schema = spark.createDataFrame([], "animal_id bigint, ts timestamp, seq bigint, symptom_1 string, symptom_2 string, suggestion string, special_care string").schema
    src, ckpt = scratch_path(spark, "edit-src"), scratch_path(spark, "edit-ckpt")
    for n in (2, 3, 1):
        rows = [(k, datetime(2024, 1, 1), 10 * n + k, f"s{n}", None, None, None) for k in (1, 2)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        V.run_edit_stream(spark, src, schema, ckpt)
    assert sorted((r.animal_id, r.seq, r.symptom_1, r.symptom_2) for r in V.read_edit_state(spark, ckpt).collect()) == [(1, 31, "s3", None), (2, 32, "s3", None)]


def test_saved_versions_are_spark_tables(spark):
    import uuid

    import pytest
    from herdlens.sources import records
    from herdlens.sources.tables import scratch_path

    name, path = f"vt_{uuid.uuid4().hex}", scratch_path(spark, "vt-test")
    with pytest.raises(FileNotFoundError):
        records.current_table(spark, name)
    for n in (3, 5, 9):
        records.save_table(spark.range(n), name, "id", 4, path)
        assert records.current_table(spark, name).count() == n
    records.retire_versions(spark, name, keep=2)
    assert records.table_versions(spark, name) == [2, 3] and spark.table(f"{name}_v2").count() == 5


def test_shared_folder_is_refused_off_one_machine(spark):
    from types import SimpleNamespace

    import pytest
    from herdlens.sources.tables import NoSharedFolder, shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(NoSharedFolder):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_csv_header_is_read_by_name(spark):
    import pytest
    from herdlens.sources.records import MissingColumns, read_records_csv, write_records_csv
    from herdlens.sources.tables import scratch_path

    path = scratch_path(spark, "csv-test")
    rows = [("Bo", "A12", 'He said ""hi"", ok\n\nnew "line"'), ("nan", "7", "NA")]
    write_records_csv(spark.createDataFrame(rows, "name string, animal_id string, doctor_suggestion string"), path,
                      headers={"name": "Name", "animal_id": "Animal ID", "doctor_suggestion": "Doctor Suggestion"})
    got = [tuple(r) for r in read_records_csv(spark, path, ["animal_id", "name", "doctor_suggestion", "bp"]).orderBy("animal_id").collect()]
    assert got == [("7", None, None, None), ("A12", "Bo", rows[0][2], None)]
    with pytest.raises(MissingColumns):
        read_records_csv(spark, path, required=["animal_id", "bp"])


def test_reports_with_text_ids(spark):
    from herdlens.sources.records import write_reports
    from herdlens.sources.tables import scratch_path

    path = scratch_path(spark, "reports-test")
    write_reports(spark.createDataFrame([("A12", "x"), (None, "y")], "animal_id string, text string"), path)
    assert spark.read.json(path).count() == 2


def test_text_keys_merge(spark):
    base = spark.createDataFrame([("A1", "p"), ("7", "q")], "animal_id string, vaccination_1 string")
    entries = spark.createDataFrame([(7, datetime(2024, 1, 1), 1, "v (d)")], "animal_id bigint, ts timestamp, seq bigint, text string")
    got = {r.animal_id: (r.vaccination_1, r.vaccination_2) for r in updates.vaccination_push(base, entries, order=None).collect()}
    assert got == {"A1": ("p", ""), "7": ("v (d)", "q")}


def test_first_row_gets_the_vaccination(spark):
    base = spark.createDataFrame([(1, 0, "old"), (1, 1, "dup")], "animal_id bigint, pos bigint, vaccination_1 string")
    entries = spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "new (d)")], "animal_id bigint, ts timestamp, seq bigint, text string")
    got = updates.vaccination_push(base, entries, order="pos").orderBy("pos").collect()
    assert [(r.vaccination_1, r.vaccination_2) for r in got] == [("new (d)", "old"), ("dup", "")]


def test_alias_zero_and_nan(spark):
    df = spark.createDataFrame([("0", "72"), ("nan", "72"), (None, "NaN"), ("0.0", "")], "heart_rate string, heart_rate_bpm string")
    a, b = (filters.alias_value(df, FV.HEART_RATE_NAMES, "-", zero_falls_through=z) for z in (True, False))
    assert [tuple(r) for r in df.select(a.alias("a"), b.alias("b")).collect()] == [("72", "0"), ("72", "72"), ("-", "-"), ("-", "0.0")]


def test_report_reads_past_nan_text(spark):
    df = spark.createDataFrame([(1, "nan", "12", "x", "asked")], "animal_id int, age_years string, age string, disease string, req string")
    lines = {r.line_no: r.text for r in reports.animal_report(df, request_col="req").collect()}
    assert lines[3] == "12" and lines[8] == "asked"
    assert reports.record_card(df).first().age == "12"
    assert df.select(reports.detected_disease(df, chain="detected").alias("d")).first().d == ""


def test_verdict_texts(spark):
    got = {r.s: r.verdict for r in rules.health_verdict(spark.createDataFrame([("Healthy",), ("Sick",), ("",)], "s string"), "s").collect()}
    assert got == {"Healthy": "🟢 The animal appears healthy.", "Sick": "🔴 The animal may need medical attention.", "": None}


def test_lookup_with_a_hot_key_and_clashing_names(spark):
    req = spark.range(500).select(F.lit("7").alias("rid"), F.col("id").alias("name"))
    rec = spark.createDataFrame([("7", "Bo", 1), ("7", "Dup", 2), ("8", "No", 3)], "animal_id string, name string, _input_order int")
    out = filters.lookup(req, "rid", rec, "animal_id").collect()
    assert len(out) == 500 and {(r.animal_id, r.record_name) for r in out} == {("7", "Bo")}
    assert sorted(r.name for r in out) == list(range(500))


def test_strict_systolic_stops(spark):
    import pytest

    good = records(spark, [dict(animal_id=1, bp="120/80"), dict(animal_id=2, bp=None)])
    assert [r.bp_num for r in clean.bp_systolic_num(good, on_error="fail").orderBy("animal_id").collect()] == [120.0, None]
    with pytest.raises(Exception, match="could not convert"):
        clean.bp_systolic_num(records(spark, [dict(animal_id=1, bp="high")]), on_error="fail").collect()


def test_missing_class_and_unseen_values(spark, tmp_path):
    rows = [(i, float(i % 10), "a" if i % 10 < 5 else None, ["Cat", "Dog"][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y string, species string")
    model = ml.fit_classifier(df, ["x"], ["species"], "y", ml.forest("label_idx", num_trees=5))
    assert sorted(model.labels) == ["a", "nan"]
    model.save(spark, str(tmp_path / "m"))
    model = ml.FittedClassifier.load(spark, str(tmp_path / "m"))
    odd = spark.createDataFrame([(1, 1.0, "Yak"), (2, 9.0, None)], "id int, x double, species string")
    assert {r.id: r.predicted_label for r in model.predict(odd, ["id"]).collect()} == {1: "a", 2: "nan"}
    blocks = model.model.transform(odd).select("species__ohe").collect()
    assert all(sum(b.species__ohe.toArray()) == 0 for b in blocks)


def test_required_columns_check(spark):
    from herdlens.sources.records import MissingColumns, require_columns

    df = spark.createDataFrame([(1, "120/80")], "animal_id bigint, bp string")
    assert require_columns(df, ["bp"]) is df
    try:
        require_columns(df, ["bp", "heart_rate"])
        raise AssertionError("expected a missing-column error")
    except MissingColumns as e:
        assert "heart_rate" in str(e)


def test_medians_over_partitions(spark):
    import statistics

    rows = [(float(i * 37 % 1001), float(i % 2) if i % 3 else None, None, float("nan")) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = clean.medians_of(df, ["a", "b", "c", "d"])
    assert got == {"a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows if r[1] is not None), "c": None, "d": None}
    assert clean.medians_of(df.limit(0), ["a"]) == {"a": None}
    assert abs(clean.medians_of(df, ["a"], "approx")["a"] - got["a"]) < 2
