"""Reports, lists and counts kept up to date from changes (RP1, RP2, R6, M10).

A view of the records is kept as a bag: rows with the number of their copies, as
signed differences one batch after the other. A batch of changes reads the records
it names, takes out what they gave before and puts in what they give now; what
stays the same cancels out and isn't written. Counts are bags of rows without the
key, so they change by the difference too.

Batches come in time order; within a batch the changes' own order decides. A
batch writes a folder of its own and reads earlier ones only, so a batch run
again after a failure gives the same result.

Rows are stored by a hash part of their key, and a batch reads the parts of its
keys alone. At most ``parts`` part numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from herdlens.operators import updates
from herdlens.sources.tables import passing_scratch, stored

COPIES, PART, BATCH = "_copies", "_part", "_batch"
View = Callable[[DataFrame], DataFrame]


def netted(signed: DataFrame, spread: bool = True) -> DataFrame:
    """One row per different row, with its summed-up copies; rows that cancel out are gone.

    With ``spread`` rows are dealt out by their values first. Summing up within a
    scan's tasks would hold nearly all of their rows, as few of them are equal; it
    pays off for views of few different rows.
    """
    rows = [c for c in signed.columns if c not in (COPIES, PART, BATCH)]
    if spread:
        signed = signed.repartition(*rows)
    return signed.groupBy(*rows).agg(F.sum(COPIES).alias(COPIES)).where(F.col(COPIES) != 0)


def view_changes(before: DataFrame, after: DataFrame, view: View, spread: bool = True) -> DataFrame:
    """How ``view`` changes when the records ``before`` become ``after``: rows with copies below or above zero.

    ``view`` must work row by row, so that its rows depend on one record each.
    """
    old = view(before).withColumn(COPIES, F.lit(-1).cast("long"))
    return netted(old.unionByName(view(after).withColumn(COPIES, F.lit(1).cast("long"))), spread)


def expanded(bag: DataFrame) -> DataFrame:
    """The rows of a bag, each as often as it has copies."""
    return bag.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))).drop(COPIES)


def parts_for(records: DataFrame, rows_per_part: int = 50_000, most: int = 4096) -> int:
    """How many parts to store ``records`` in: a batch reads one at least, and one task writes one."""
    return min(most, max(8, -(-records.count() // rows_per_part)))


class RefreshedViews:
    """Records under ``path`` and row-by-row views of them, refreshed batch by batch.

    ``schema`` is the records' schema; it holds ``key`` and the columns that edits and
    vaccinations set. Keys without a record and null keys change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, views: Mapping[str, View], key: str = "animal_id", parts: int = 256):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.views: dict[str, View] = {"records": lambda r: r, **views}
        empty = spark.createDataFrame([], schema)
        self.schemas = {name: view(empty).schema for name, view in self.views.items()}

    def _part(self, key: str | None) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int") if key else F.lit(0)

    def _write(self, name: str, batch: int, signed: DataFrame) -> None:
        part = self._part(self.key if self.key in signed.columns else None)
        # Rebalancing splits a part that one key makes large.
        (signed.withColumn(PART, part).hint("rebalance", PART)
         .write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{name}/{BATCH}={batch}"))

    def _keyed(self, name: str) -> bool:
        return self.key in self.schemas[name].names

    def _signed(self, name: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        schema = StructType([*self.schemas[name].fields]).add(COPIES, LongType()).add(BATCH, IntegerType()).add(PART, IntegerType())
        signed = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        if before is not None:
            signed = signed.where(F.col(BATCH) < before)
        if parts is not None:
            signed = signed.where(F.col(PART).isin(parts))
        return signed

    def bag(self, name: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """View ``name`` with copies: after all batches, or after those below ``before``; of all ``parts`` or some."""
        return netted(self._signed(name, before, parts), self._keyed(name))

    def rows(self, name: str) -> DataFrame:
        return expanded(self.bag(name))

    def load(self, records: DataFrame) -> None:
        """Batch 0: all records are new. Rows with a key are written as they are and summed up when read."""
        records = records.select(*self.schemas["records"].names)
        for name, view in self.views.items():
            rows = view(records).withColumn(COPIES, F.lit(1).cast("long"))
            self._write(name, 0, rows if self._keyed(name) else netted(rows, False))

    def before(self, batch: int, keys: DataFrame) -> DataFrame:
        """The records of ``keys`` (one column) before ``batch``; only the parts of these keys are read."""
        text = stored(keys.select(F.col(self.key).cast("string").alias("_text")).where(F.col("_text").isNotNull()).distinct(), "refresh-keys")
        touched = [r[0] for r in text.select(self._part("_text")).distinct().collect()]
        held = self._signed("records", batch, touched).withColumn("_text", F.col(self.key).cast("string"))
        # One exchange by the key serves the join and the sums.
        return expanded(netted(held.repartition("_text").join(text, "_text", "left_semi"), False).drop("_text"))

    def refresh(self, batch: int, edits: DataFrame, entries: DataFrame, order_cols=("ts", "seq")) -> None:
        """Apply a batch (1, 2, ...) of record edits and accepted vaccinations to the records and all views."""
        if batch < 1:
            raise ValueError("batch 0 is the load")
        keys = edits.select(self.key).unionByName(entries.select(self.key))
        with passing_scratch():
            before = stored(self.before(batch, keys), "refresh-before")
            after = stored(updates.apply_changes(before, edits, entries, self.key, order_cols).select(*before.columns), "refresh-after")
            for name, view in self.views.items():
                self._write(name, batch, view_changes(before, after, view, self._keyed(name)))

    def compact(self, path: str) -> RefreshedViews:
        """The same state under a new ``path`` as one load, without the batches that led to it."""
        schema = self.schemas["records"]
        views = {n: v for n, v in self.views.items() if n != "records"}
        new = RefreshedViews(self.spark, path, schema, views, self.key, self.parts)
        for name in self.views:
            new._write(name, 0, self.bag(name))
        return new
