"""Medians by mergeable quantile sketches (C4/C5 over a stream of files).

A KLL sketch of a column is a few kilobytes whatever the rows, and sketches
merge: new files are sketched alone, earlier ones are never read again. With
``SKETCH_K`` a value's rank is off by less than ``RANK_ERROR`` of the rows at
99 % confidence. Exact medians (``clean.medians_of``) stay the default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SKETCH_K = 4096
RANK_ERROR = 0.002


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def sketched(df: DataFrame, cols: Sequence[str], by: Sequence[str | Column] = (), k: int = SKETCH_K) -> DataFrame:
    """One sketch of each column per group (``by``; no group: one row); nulls and NaN take no part."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(_number(c), k).alias(c) for c in cols])


def merged(sketches: DataFrame, cols: Sequence[str], by: Sequence[str | Column] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches of all rows (per group) as one."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c, k).alias(c) for c in cols])


def quantiles(sketches: DataFrame, cols: Sequence[str], q: float = 0.5) -> DataFrame:
    """(column_name, n, quantile) of the merged sketches; no value has no quantile."""
    one = merged(sketches, cols)
    n = {c: F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0)).cast("bigint") for c in cols}
    rows = [F.struct(F.lit(c).alias("column_name"), n[c].alias("n"),
                     F.when(n[c] > 0, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias("quantile")) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def medians(sketches: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Column -> median, as ``clean.medians_of`` gives it."""
    return {r["column_name"]: r["quantile"] for r in quantiles(sketches, cols).collect()}


def run_sketch_stream(spark: SparkSession, source_dir: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame],
                      cols: Sequence[str], sketch_dir: str, checkpoint_dir: str, files_per_trigger: int | None = None,
                      k: int = SKETCH_K) -> None:
    """Sketch every file not yet sketched (one row a file), then stop (``availableNow``).

    Each batch writes a folder named by its number, so a batch that is repeated
    after a failure replaces its own rows.
    """
    stream = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    rows = prepare(stream.parquet(source_dir).withColumn("file", F.col("_metadata.file_path")))

    def save(batch: DataFrame, number: int) -> None:
        sketched(batch, cols, ["file"], k).write.mode("overwrite").parquet(f"{sketch_dir}/batch={number}")

    q = (rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_sketches(spark: SparkSession, sketch_dir: str) -> DataFrame:
    """(file, one sketch a column) of all batches so far."""
    return spark.read.parquet(sketch_dir)
