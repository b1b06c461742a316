"""Rule tables as data: the q-gram index join against plain substring tests; the RBF features."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import ml, rule_index, rules

WORDS = ["fever", "Cough", "naïve", "a.b", "(x)", "tick", "ümlaut", "x", "blisters on mouth", "joint swelling"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choices(WORDS, k=6)), rng.choice([None, "", "tick fever", "line\nbreak (x)"]), k) for k in range(60)]
    rows = [(k, f"d{k % 9}", rng.choice(WORDS + ["line\nbreak", "no such", "er c", "ïv", "x)"]).lower()) for k in range(40)] + [(3, "d3", "tick")] * 2
    return (spark.createDataFrame(texts, "id int, s1 string, s2 string, row int").repartition(3),
            spark.createDataFrame(rows + [(90, "null", None), (91, "empty", "")], "ord int, disease string, kw string"), texts, rows)


def brute(texts, rows, mode):
    out = {}
    for k, a, b, _ in texts:
        t = [rules_norm(a), rules_norm(b)]
        score = {}
        for o, d, kw in rows:
            hits = sum(kw in x for x in t)
            score[o, d] = score.get((o, d), 0) + (hits if mode == "each" else min(hits, 1))
        out[k] = score
    return out


def rules_norm(x):
    return (x or "").strip().lower()


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("mode", ["each", "any"])
def test_index_equals_substring_tests(table, broadcast_rows, mode):
    df, rule_df, texts, rows = table
    want = brute(texts, rows, mode)
    got = rule_index.keyword_scores(df, ["id"], ["s1", "s2"], rule_df, mode, broadcast_rows=broadcast_rows).collect()
    assert {(r.id, r.ord, r.label): r.score for r in got} == {(k, *x): n for k, s in want.items() for x, n in s.items() if n}
    top = rule_index.keyword_top1(df, ["s1", "s2"], rule_df, mode, broadcast_rows=broadcast_rows, fallback="-")
    assert top.columns == [*df.columns, "disease"]
    assert {r.id: r.disease for r in top.collect()} == {
        k: min(s.items(), key=lambda x: (-x[1], x[0][0]))[0][1] if any(s.values()) else "-" for k, s in want.items()}
    first = rule_index.first_match_label(df, ["s1", "s2"], rule_df, label_col="disease", broadcast_rows=broadcast_rows)
    assert {r.id: r.label for r in first.collect()} == {
        k: min(((o, d) for (o, d), n in s.items() if n), default=(0, None))[1] for k, s in want.items()}


def test_index_of_nothing(spark, table):
    df, rule_df, _, _ = table
    assert {r.disease for r in rule_index.keyword_top1(df, ["s1"], rule_df.limit(0), fallback="-").collect()} == {"-"}
    assert rule_index.keyword_top1(df.limit(0), ["s1"], rule_df).collect() == []


def test_index_equals_the_rule_array(spark):
    from conftest import SF_SMALL
    from herdlens.sources import views

    a = views.animal(spark, SF_SMALL).select("animal_id", "symptom_1", "symptom_2")
    table = spark.createDataFrame([(i, d, k) for i, (d, ks) in enumerate(FV.DISEASE_KEYWORDS, 1) for k in ks], "ord int, disease string, kw string")
    want = {r.animal_id: r.disease for r in rules.keyword_top1(a, ["symptom_1", "symptom_2"]).collect()}
    assert {r.animal_id: r.disease for r in rule_index.keyword_top1(a, ["symptom_1", "symptom_2"], table).collect()} == want


def test_index_join_has_no_cross_join(spark, table):
    df, rule_df, _, _ = table
    for n in (1000, 0):
        plan = rule_index.keyword_top1(df, ["s1"], rule_df, broadcast_rows=n)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    w, b = ml.rbf_weights(6, 1 / 6, 2000)
    z = (2 / 2000) ** 0.5 * np.cos(x @ w.T + b)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 6)
    assert np.abs(z @ z.T - exact).max() < 0.12 and np.abs(z @ z.T - exact).mean() < 0.025


def test_only_wanted_windows_leave_their_text(spark):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choices("abcdefghij ", k=3000)) + ("swollen ûdder" if k % 3 == 0 else "")) for k in range(12)]
    ix = rule_index.RuleIndex(spark.createDataFrame(texts, "id int, s string"), ["s"], spark.createDataFrame([(1, "m", "swollen ûdder")], "ord int, disease string, kw string"))
    left = ix._found(ix.index.select("gram")).count()
    assert 4 <= left <= 40  # of some 36,000 windows
    assert {(r.row, r.kw) for r in ix.hits().collect()} == {(r.row, "swollen ûdder") for r in ix.long.where("text like '%udder' or text like '%ûdder'").collect()}


@pytest.mark.parametrize("size", rule_index.SIZES)
def test_windows_of_pieces(size, monkeypatch):
    text = "naïve 𝒳 tick\nfever, naïve tick".encode()
    whole = np.concatenate(list(rule_index.windows(text, size)))
    want = [int.from_bytes(text[i:i + size], "little") + ((size << 56) if size < 8 else 0) for i in range(len(text) - size + 1)]
    assert whole.tolist() == want
    monkeypatch.setattr(rule_index, "PIECE_BYTES", 7)
    assert np.concatenate(list(rule_index.windows(text, size))).tolist() == want
    assert list(rule_index.windows(b"", size)) == []
