"""One-hot encoding of text columns with any number of values (M3, M5).

MLlib's indexer brings a column's values to the driver. Here the vocabulary is a
stored table (column, value, place): all columns' values are ranked together by
range partitions, so a value's rank is its place in the vector. Rows find their
places by one equi-join a column, which AQE makes a broadcast where the measured
vocabulary is small and splits where a value is hot. The driver holds one number,
the length of the vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from herdlens.operators.ml import stack_columns
from herdlens.sources.tables import ranked, scratch_path, stored


class WideOneHot:
    """Places of the values of ``columns``; unseen values and nulls have none.

    Places follow the columns' order, then the values', as MLlib's encoder with
    alphabetical labels has them. No training rows give vectors of length 0.
    """

    def __init__(self, vocabulary: DataFrame, columns: Sequence[str], size: int):
        self.vocabulary, self.columns, self.size = vocabulary, list(columns), size

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> WideOneHot:
        seen = stack_columns(train, [], columns).where(F.col("value").isNotNull()).distinct()
        column_no = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
        vocabulary = stored(ranked(seen, [column_no, F.col("value")], "one-hot", "place"), "one-hot").select("column_name", "value", "place")
        return WideOneHot(vocabulary, columns, vocabulary.count())

    def places(self, df: DataFrame, out: str = "places") -> DataFrame:
        """``df`` with the ascending array ``out`` of the places that are one; one at most a column."""
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                         *[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(self.columns)])
        for i, c in enumerate(self.columns):
            known = self.vocabulary.where(F.col("column_name") == c).select(F.col("value").alias(f"v{i}"), F.col("place").cast("int").alias(f"p{i}"))
            rows = rows.join(known, f"v{i}", "left")
        return rows.select("row.*", F.array_compact(F.array(*[F.col(f"p{i}") for i in range(len(self.columns))])).alias(out))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the sparse vector ``out``, stored.

        The vector is written as the struct it is stored as and read back as a
        vector, so no row passes through Python.
        """
        held = self.places(df, out)
        ones = F.array_repeat(F.lit(1.0), F.size(out))
        sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"), F.col(out).alias("indices"), ones.alias("values"))
        held = held.withColumn(out, sparse)
        path = scratch_path(df.sparkSession, "one-hot-vectors")
        held.write.parquet(path)
        schema = StructType([StructField(out, VectorUDT()) if f.name == out else f for f in held.schema])
        return df.sparkSession.read.schema(schema).parquet(path)

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, columns: Sequence[str]) -> WideOneHot:
        vocabulary = spark.read.parquet(path)
        return WideOneHot(vocabulary, columns, vocabulary.count())
