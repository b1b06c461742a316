"""One-hot places by a stored vocabulary equal MLlib's encoder, at any number of values."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from herdlens.operators.encoders import WideOneHot

ROWS = [(1, "b", "x", 1.0), (2, "a", None, 2.0), (3, "b", "y", 3.0), (4, None, "é", 4.0), (5, "0", "x", 5.0), (5, "0", "x", 5.0)]
SCHEMA = "id long, one string, two string, place double"


@pytest.fixture()
def train(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_vectors_equal_the_mllib_encoder(spark, train):
    seen = spark.createDataFrame([*ROWS, (6, "unseen", "y", 0.0), (7, "B", None, 0.0), (8, None, None, 0.0)], SCHEMA)
    cols = ["one", "two"]
    idx, ohe = [f"{c}_i" for c in cols], [f"{c}_v" for c in cols]
    mllib = Pipeline(stages=[StringIndexer(inputCols=cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
                             OneHotEncoder(inputCols=idx, outputCols=ohe), VectorAssembler(inputCols=ohe, outputCol="f")]).fit(train)
    want = sorted((r.id, *r.f.toArray()) for r in mllib.transform(seen).collect())
    encoder = WideOneHot.fit(train, cols)
    got = encoder.vectors(seen)
    assert got.columns == [*seen.columns, "features"]
    assert sorted((r.id, *r.features.toArray()) for r in got.collect()) == want
    assert encoder.size == 6


def test_clashing_names_and_save(spark, train, tmp_path):
    clash = train.select("*", F.lit(1).alias("v0"), F.lit(2).alias("p0"), F.lit(3).alias("row"), F.lit(4).alias("value"), F.lit(5).alias("column_name"))
    encoder = WideOneHot.fit(clash, ["one", "two"])
    encoder.save(str(tmp_path / "vocabulary"))
    again = WideOneHot.load(spark, str(tmp_path / "vocabulary"), ["one", "two"])
    assert again.size == encoder.size
    got = again.places(clash).orderBy("id").collect()
    assert [(r.v0, r.p0, r.row, r.value, r.column_name) for r in got] == [(1, 2, 3, 4, 5)] * 6
    assert got[0].places == [2, 3] and got[1].places == [1] and got[4].places == [0, 3]


def test_empty_text_is_a_value(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, None)], "id long, one string")
    got = {r.id: r.places for r in WideOneHot.fit(df, ["one"]).places(df).collect()}
    assert got == {1: [0], 2: [1], 3: []}


def test_nothing_to_fit(spark, train):
    encoder = WideOneHot.fit(train.limit(0), ["one"])
    assert encoder.size == 0
    assert all(r.places == [] for r in encoder.places(train).collect())
    assert WideOneHot.fit(train, ["one"]).vectors(train.limit(0)).count() == 0


def test_a_million_values_stay_off_the_driver(spark, monkeypatch):
    wide = spark.range(1_000_000).select(F.concat(F.lit("value "), F.col("id")).alias("one"), F.lit("hot").alias("two"))
    taken = []
    collect = type(wide).collect
    monkeypatch.setattr(type(wide), "collect", lambda self: taken.append(len(rows := collect(self))) or rows)
    encoder = WideOneHot.fit(wide, ["one", "two"])
    assert encoder.size == 1_000_001
    one = encoder.places(wide).agg(F.countDistinct(F.element_at("places", 1)).alias("n"), F.min(F.size("places")).alias("least"),
                                   F.min(F.element_at("places", -1)).alias("hot")).first()
    assert (one.n, one.least, one.hot) == (1_000_000, 2, 1_000_000)
    assert max(taken, default=0) <= 1
