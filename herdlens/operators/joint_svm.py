"""One-vs-rest linear SVMs whose classes are fitted together: for training tables that MLlib's ``OneVsRest`` outgrows.

``OneVsRest`` fits each class by itself: its own standardised copy of the rows, and a
small job for every step of every class. Here the rows are kept once, in blocks, and a
job gives the hinge loss and gradient of all classes at the points that they ask for, so jobs
follow the slowest class and not the sum of all. Objective, centred and scaled features, start, OWL-QN
with ten corrections, stopping rules and iteration limit are MLlib's; its line search is not copied, so
steps and coefficients differ from MLlib's. Only one sum a task, as large as the coefficients, reaches the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from herdlens.sources.tables import ship

#: Bytes of features in a block, and rows that a task goes through.
BLOCK_BYTES = 1 << 21
TASK_ROWS = 200_000
_Point = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class _NoStep(Exception):
    pass


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the approximate inverse Hessian (two-loop recursion, newest step first) times the gradient."""
    out, used = grad.copy(), []
    for s, y in steps:
        rho = s @ y
        if not rho:
            raise _NoStep
        a = (s @ out) / rho
        used.append((a, rho))
        out -= a * y
    if steps:
        s, y = steps[0]
        if s @ y < 0:
            raise _NoStep
        out *= (s @ y) / (y @ y)
    for (s, y), (a, rho) in zip(reversed(steps), reversed(used)):
        out += (a - (y @ out) / rho) * s
    # OWL-QN's rule: no coordinate goes against the gradient's sign.
    return np.where(-out * grad < 0, -out, 0.0)


def minimise(width: int, max_iter: int, tol: float, memory: int = 10) -> _Point:
    """OWL-QN without an L1 part, from zero, with backtracking to the strong Wolfe conditions: yields points, is sent (loss, gradient), returns the last point."""
    x = np.zeros(width)
    value, grad = yield x
    first, steps, recent, it, failed = value, [], [math.inf], 0, False
    while it < max_iter:
        if len(recent) >= 2 and abs(value - max(recent)) <= tol * first:
            break
        if np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            move = _direction(grad, steps)
            slope = move @ grad
            orthant = np.where(x != 0, np.sign(x), -np.sign(grad))
            alpha, shrink = (0.5 / np.linalg.norm(grad), 0.1) if it < 1 else (1.0, 0.5)
            for _ in range(20):
                at = x + alpha * move
                at = np.where(np.sign(at) == orthant, at, 0.0)
                new_value, new_grad = yield at
                new_slope = new_grad @ move
                if new_value > value + alpha * slope * 1e-4:
                    by = shrink
                elif new_slope < 0.9 * slope:
                    by = 2.1
                elif new_slope > -0.9 * slope:
                    by = shrink
                else:
                    break
                if not 1e-10 <= alpha * by <= 1e10:
                    raise _NoStep
                alpha *= by
        except _NoStep:
            if failed:
                break
            failed, steps = True, []
            continue
        failed = False
        steps = [(at - x, new_grad - grad), *steps][:memory]
        x, value, grad, it = at, new_value, new_grad, it + 1
        recent = [*recent, value][-20:]
    return x


def hinge(x: np.ndarray, y: np.ndarray, classes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of loss and gradient (coefficients, intercept last) of each class against the rest, at its point."""
    sign = np.where(y[:, None] == classes, 1.0, -1.0)
    short = 1.0 - sign * (x @ points[:, :-1].T + points[:, -1])
    pull = np.where(short > 0, -sign, 0.0)
    return np.maximum(short, 0).sum(axis=0), np.hstack([pull.T @ x, pull.sum(axis=0)[:, None]])


def _packed(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> RDD:
    """(classes, centred and scaled features) of the rows in blocks; an RDD, as a pass over one needs no plan of its own."""
    size = max(1, BLOCK_BYTES // (8 * len(mean)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            if not np.isfinite(x).all():
                raise ValueError("features must not be NaN or infinite")
            x = (x - mean) * scale
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
            parts = range(0, len(y), size)
            yield pa.RecordBatch.from_arrays([pa.array([y[i:i + size].tobytes() for i in parts], pa.binary()),
                                              pa.array([x[i:i + size].tobytes() for i in parts], pa.binary())], ["y", "x"])

    return rows.mapInArrow(pack, "y binary, x binary").rdd.map(lambda r: (bytes(r.y), bytes(r.x)))


def _sums(blocks: RDD, width: int, classes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient sums of the asked classes: one pair a task, added up in a fixed order."""

    def task(part: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        loss, grad = np.zeros(len(classes)), np.zeros(points.shape)
        for y, x in part:
            one = hinge(np.frombuffer(x).reshape(-1, width), np.frombuffer(y, np.int32), classes, points)
            loss, grad = loss + one[0], grad + one[1]
        yield loss, grad

    found = blocks.mapPartitions(task).collect()
    return tuple(np.sum(v, axis=0) for v in zip(*found))


class JointSVM:
    """A fitted one-vs-rest linear SVM: labels, feature pipeline, a row of coefficients and intercept a class."""

    def __init__(self, labels: list[str], features: PipelineModel, weights: np.ndarray):
        self.labels, self.features, self.weights = labels, features, weights

    @staticmethod
    def fits(classifier) -> bool:
        """Whether the classes' estimator is a plain ``LinearSVC``: no penalty, scaled features, an intercept, no weights."""
        return (isinstance(classifier, LinearSVC) and classifier.getRegParam() == 0 and classifier.getStandardization()
                and classifier.getFitIntercept() and not classifier.isSet("weightCol") and classifier.getThreshold() == 0)

    @staticmethod
    def fit(train: DataFrame, label_idx: str, labels: list[str], features: PipelineModel, max_iter: int, tol: float,
            read: Callable[[], None] = lambda: None) -> JointSVM:
        """``train`` is read three times; of its rows only the blocks are kept, and ``read`` is called when they are there."""
        spark = train.sparkSession
        ship(spark)
        rows = features.transform(train).select(F.col(label_idx).cast("int").alias("y"), "features")
        s = rows.agg(F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).first()
        mean, std = s.s.mean.toArray(), s.s.std.toArray()
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
        width = len(mean)
        tasks = -(-s.n // TASK_ROWS)
        if tasks > train.rdd.getNumPartitions():
            rows = features.transform(train.repartition(tasks)).select(F.col(label_idx).cast("int").alias("y"), "features")
        blocks = _packed(rows.select("y", vector_to_array("features").alias("x")), mean, scale).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            blocks.count()
            read()
            runs = {k: minimise(width + 1, max_iter, tol) for k in range(len(labels))}
            asked, done = {k: next(r) for k, r in runs.items()}, {}
            while asked:
                classes = np.array(sorted(asked))
                loss, grad = _sums(blocks, width, classes, np.array([asked[k] for k in classes]))
                for k, a, g in zip(classes.tolist(), loss / s.n, grad / s.n):
                    try:
                        asked[k] = runs[k].send((float(a), g))
                    except StopIteration as end:
                        done[k] = end.value
                        del asked[k]
        finally:
            blocks.unpersist()
        found = np.array([done[k] for k in range(len(labels))])
        weights = np.hstack([found[:, :-1] * scale, found[:, -1:] - (found[:, :-1] * scale) @ mean[:, None]])
        return JointSVM(labels, features, weights)

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``predicted_label``: the class whose line gives the row the greatest value."""
        ship(df.sparkSession)
        weights = self.weights

        @F.pandas_udf("int")
        def best(x: pd.Series) -> pd.Series:
            return pd.Series((np.stack(x.to_numpy()) @ weights[:, :-1].T + weights[:, -1]).argmax(axis=1).astype(np.int32) if len(x) else [], dtype="int32")

        labels = F.array(*[F.lit(v) for v in self.labels])
        out = self.features.transform(df).withColumn("predicted_label", F.element_at(labels, best(vector_to_array("features")) + 1))
        return out.select(*keep, "predicted_label")

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        meta = json.dumps({"labels": self.labels, "weights": self.weights.tolist()})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/joint_svm")

    @staticmethod
    def load(spark: SparkSession, path: str) -> JointSVM:
        m = json.loads(spark.read.parquet(f"{path}/joint_svm").first().meta)
        return JointSVM(m["labels"], PipelineModel.load(f"{path}/features"), np.array(m["weights"]))
