"""Model operators (M1-M12) on Spark MLlib.

Preprocessing that has a closed SQL form (split, scaling, one-hot in long
form, label encoding, accuracy) is written as DataFrame expressions so it
can be checked against SQL; the forests and the SVM are MLlib estimators in
a ``Pipeline`` (distributed training: one aggregation of split statistics
per tree level, no data on the driver).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import (IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.storagelevel import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators.dealt_forest import DealtForest
from herdlens.operators.joint_svm import JointSVM
from herdlens.sources.tables import path_exists, ranked, shared_dir, stored

SEED = 42
#: Training rows below which another task costs more than it brings.
ROWS_PER_TASK = 10_000
#: Training rows up to which MLlib grows a forest; more are dealt to (tree, node).
MLLIB_FOREST_ROWS = 20_000
#: Training rows up to which MLlib fits an SVM class by class; with more, all classes share each pass.
MLLIB_SVM_ROWS = 20_000


# --- M1 split ---

def hash_bucket(key: str | Column, buckets: int = FV.TEST_FRACTION_BUCKETS) -> Column:
    """Deterministic bucket of a key from its md5 (independent of partitioning)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def hash_split(df: DataFrame, key: str, buckets: int = FV.TEST_FRACTION_BUCKETS,
               out: str = "split") -> DataFrame:
    """Bucket 0 of ``buckets`` is the test set (20 % for 5 buckets)."""
    return df.withColumn(out, F.when(hash_bucket(key, buckets) == 0, F.lit("test"))
                         .otherwise(F.lit("train")))


# --- M2 scaling ---

def standard_scale(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; a zero std scales by 1.

    Mean and std are scalar subqueries (Spark merges them into one aggregate
    job) and are inlined as constants: no join.
    """
    src = source if source is not None else df
    out = {}
    for c in cols:
        stats = src.select(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"))
        m = stats.select("m").scalar()
        s = stats.select(F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))).scalar()
        out[c] = (F.col(c) - m) / s
    return df.withColumns(out)


# --- M3 / M4 categorical encodings ---

def stack_columns(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
                  null_as: str | None = None) -> DataFrame:
    """Long form (ids..., column_name, value) through a narrow ``inline``."""
    def val(c):
        v = F.col(c).cast("string")
        return F.coalesce(v, F.lit(null_as)) if null_as is not None else v
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), val(c).alias("value")) for c in cols])
    return df.select(*id_cols, F.inline(arr))


def one_hot_long(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
                 vocabulary_from: DataFrame) -> DataFrame:
    """(ids..., column_name, category) for every value seen in the training frame.

    Unseen values and nulls get no row (an all-zero one-hot vector). The
    vocabulary is the distinct (column, value) set of the training frame;
    AQE broadcasts it when its measured size is small and otherwise uses a
    shuffle join.
    """
    vocab = (stack_columns(vocabulary_from, [], cols).where(F.col("value").isNotNull())
             .distinct())
    long = stack_columns(df, id_cols, cols).where(F.col("value").isNotNull())
    return long.join(vocab, ["column_name", "value"], "left_semi").withColumnRenamed(
        "value", "category")


def label_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Vocabularies (column_name, value, code) of text columns: code = rank in the column's sorted value order.

    Nulls are encoded as the text 'nan' (they are stringified first). The
    distinct pairs of all columns are ranked together by range partitions with
    offsets, so a large vocabulary is never sorted by one task; a column's codes
    count from its first place.
    """
    vocab = stack_columns(df, [], cols, null_as="nan").distinct()
    placed = stored(ranked(vocab, [F.col("column_name"), F.col("value")], "codes", "place"), "codes")
    # As many rows as there are columns.
    first = placed.groupBy("column_name").agg(F.min("place").alias("first"))
    return (placed.join(F.broadcast(first), "column_name")
            .select("column_name", "value", (F.col("place") - F.col("first")).alias("code")))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each text column by its code (one vocabulary join per column, of one stored vocabulary)."""
    codes = label_codes(df, cols)
    out = df
    for c in cols:
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = (out.withColumn(f"_v_{c}", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
               .join(m, f"_v_{c}", "left").drop(f"_v_{c}", c).withColumnRenamed(f"_c_{c}", c))
    return out


# --- M10 accuracy ---

def accuracy(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, correct, accuracy_pct): share of rows with prediction == label, x100,
    rounded half-even to 2 digits."""
    hit = F.when(F.col(prediction) == F.col(label), 1).otherwise(0)
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("correct"))
            .withColumn("accuracy_pct", F.bround(F.col("correct") * 100.0 / F.col("n"), 2)))


# --- M5-M9 models ---

def forest(label_col: str, features_col: str = "features", num_trees: int = 100,
           max_depth: int = 30, seed: int = SEED) -> RandomForestClassifier:
    # Depth 30 is MLlib's own limit (the forests have none). Larger node
    # batches cut the number of passes over the training rows per tree level;
    # cached node ids save walking every tree from its root in each pass, and
    # are checkpointed in the shared folder, so their lineage stays short.
    return RandomForestClassifier(labelCol=label_col, featuresCol=features_col, numTrees=num_trees,
                                  maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed,
                                  subsamplingRate=1.0, bootstrap=True, maxMemoryInMB=1024,
                                  cacheNodeIds=True, checkpointInterval=10)


class FittedClassifier:
    """Label vocabulary (small model metadata) + fitted feature/classifier pipeline."""

    def __init__(self, labels: list[str], model: PipelineModel):
        self.labels = labels
        self.model = model

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Adds ``predicted_label`` (text) and ``probability_array`` when available."""
        out = self.model.transform(df)
        out = IndexToString(inputCol="prediction", outputCol="predicted_label",
                            labels=self.labels).transform(out)
        cols = [*keep, "predicted_label"]
        if "probability" in out.columns:
            out = out.withColumn("probability_array", vector_to_array("probability"))
            cols.append("probability_array")
        return out.select(*cols)

    def class_probability_pct(self, cls: str, prob_col: str = "probability_array") -> Column:
        """P(cls) x 100, rounded half-even to 2; class absent -> index 0."""
        idx = self.labels.index(cls) if cls in self.labels else 0
        return F.bround(F.element_at(F.col(prob_col), idx + 1) * 100.0, 2)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        labels = list(enumerate(self.labels))
        spark.createDataFrame(labels, "idx int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedClassifier | DealtForest | JointSVM:
        if path_exists(spark, f"{path}/dealt"):
            return DealtForest.load(spark, path)
        if path_exists(spark, f"{path}/joint_svm"):
            return JointSVM.load(spark, path)
        labels = spark.read.parquet(f"{path}/labels").orderBy("idx").collect()
        return FittedClassifier([r.label for r in labels], PipelineModel.load(f"{path}/model"))


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], scale: bool = True) -> list:
    """Numeric branch (assembled, standardised) + categorical branch (one-hot;
    unseen and null categories -> all zeros) -> ``features``."""
    stages = []
    cat_idx = [f"{c}__idx" for c in categorical]
    cat_vec = [f"{c}__ohe" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=cat_idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer puts unseen and null values in one last place, which is
        # the place the encoder drops: such values are all zeros.
        stages.append(OneHotEncoder(inputCols=cat_idx, outputCols=cat_vec, dropLast=True))
    stages.append(VectorAssembler(inputCols=list(numeric), outputCol="num_raw", handleInvalid="keep"))
    num_col = "num_raw"
    if scale:
        stages.append(StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True,
                                     withStd=True))
        num_col = "num_scaled"
    stages.append(VectorAssembler(inputCols=[num_col, *cat_vec], outputCol="features"))
    return stages


def rbf_weights(dims: int, gamma: float, components: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and phases whose cosines approximate exp(-gamma * distance**2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, (2 * gamma) ** 0.5, (components, dims)), rng.uniform(0, 2 * np.pi, components)


def rbf_stages(train: DataFrame, numeric: Sequence[str], components: int = 100, seed: int = SEED) -> list:
    """Standardised columns mapped to random Fourier features of the RBF kernel -> ``features``.

    gamma is 1 / (columns * variance of all standardised values). Each feature is a
    plain SQL expression with constants, so the fitted pipeline can be saved; the
    kernel's error falls with the root of ``components``.
    """
    stats = train.agg(*[x for c in numeric for x in (F.avg(c), F.stddev_pop(c))]).first()
    mean = [float(m or 0) for m in stats[::2]]
    std = [float(s or 0) for s in stats[1::2]]
    gamma = 1.0 / max(1, sum(s > 0 for s in std))
    w, b = rbf_weights(len(numeric), gamma, components, seed)
    scaled = ", ".join(f"(`{c}` - {m!r}D) / {s or 1.0!r}D AS rbf_x{k}" for k, (c, m, s) in enumerate(zip(numeric, mean, std)))
    size = float((2 / components) ** 0.5)
    waves = ", ".join(f"{size!r}D * cos({float(b[j])!r}D + " + " + ".join(f"{float(x)!r}D * rbf_x{k}" for k, x in enumerate(w[j])) + f") AS rbf_{j}"
                      for j in range(components))
    return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {waves} FROM __THIS__"),
            VectorAssembler(inputCols=[f"rbf_{j}" for j in range(components)], outputCol="features", handleInvalid="keep")]


def _label_indexer(target: str) -> StringIndexer:
    return StringIndexer(inputCol=target, outputCol="label_idx", handleInvalid="error", stringOrderType="alphabetAsc")


def fit_classifier(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   target: str, classifier, scale: bool = True,
                   stages: list | None = None) -> FittedClassifier | DealtForest | JointSVM:
    """Index the target (alphabetical classes), then fit features (``stages``, if given) + classifier.

    A forest of more than ``MLLIB_FOREST_ROWS`` rows is a ``DealtForest``; scaling doesn't matter to its bins.
    A one-vs-rest ``LinearSVC`` of more than ``MLLIB_SVM_ROWS`` rows is a ``JointSVM``.
    """
    # A missing class is the class 'nan', as it is in text form; no row is left out.
    train = train.withColumn(target, F.coalesce(F.col(target).cast("string"), F.lit("nan")))
    # Fitting makes many passes (indexers, scaler, iterations / tree levels): keep
    # the prepared rows in executor storage, spread over as many tasks as pay off.
    shared_dir(train.sparkSession)
    if isinstance(classifier, RandomForestClassifier) and stages is None:
        # Of a large table, a dealt forest needs the used columns, and only until it has its own codes.
        lean = train.select(*dict.fromkeys([*numeric, *categorical, target])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if lean.count() > MLLIB_FOREST_ROWS:
                indexer = _label_indexer(target).fit(lean)
                return DealtForest.fit(indexer.transform(lean), "label_idx", list(indexer.labels), numeric, categorical,
                                       classifier.getNumTrees(), classifier.getMaxDepth(), classifier.getSeed(), lean.unpersist)
        finally:
            lean.unpersist()
    source = train.persist(StorageLevel.MEMORY_AND_DISK)
    rows = source.count()
    spread = max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    train = source.repartition(spread).persist(StorageLevel.MEMORY_AND_DISK)

    def read() -> None:
        train.unpersist()
        source.unpersist()

    try:
        indexer = _label_indexer(target).fit(train)
        stages = stages or feature_stages(numeric, categorical, scale)
        if isinstance(classifier, OneVsRest) and rows > MLLIB_SVM_ROWS and JointSVM.fits(svm := classifier.getClassifier()):
            return JointSVM.fit(indexer.transform(train), "label_idx", list(indexer.labels), Pipeline(stages=stages).fit(train), svm.getMaxIter(), svm.getTol(), read)
        classifier.setLabelCol("label_idx").setFeaturesCol("features")
        pipe = Pipeline(stages=[*stages, classifier])
        model = pipe.fit(indexer.transform(train))
    finally:
        read()
    return FittedClassifier(list(indexer.labels), model)


def linear_svm(max_iter: int = 100, reg: float = 0.0, parallelism: int = 8) -> OneVsRest:
    """Multi-class linear SVM (one-vs-rest, classes trained concurrently); over ``rbf_stages`` an RBF-kernel SVM."""
    return OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg), parallelism=parallelism)
