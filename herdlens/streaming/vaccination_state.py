"""ST2: record edits and vaccinations kept up to date from streams of changes.

Both are Spark's own keyed streaming state in RocksDB, ordered by (event time,
sequence), so late and out-of-order files give the batch answer: the newest
edit is a streaming aggregate, the newest two vaccinations of an animal are a
list state of ``transformWithState``. The state lives in the query's checkpoint
and is read with the state data source. It meets the record table by the batch
merge, which changes the first row of an id and pushes onto what it held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from herdlens.operators import filters, updates

ORDER = ["ts", "seq"]
ENTRY_COLS = [*ORDER, "text"]
EDIT_COLS = [*ORDER, "symptom_1", "symptom_2", "suggestion", "special_care"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State stores of queries started and read inside are RocksDB's."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class NewestEntries(StatefulProcessor):
    """The newest ``keep`` different rows of a key by their leading columns, as a list state."""

    def __init__(self, schema: StructType, order: int, keep: int):
        self.schema, self.order, self.keep = schema, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {tuple(r) for r in self.newest.get()}
        names = self.schema.names
        for r in rows:
            held.add(tuple(r[c] for c in names))
            if len(held) > 4 * self.keep:
                held = set(self._first(held))
        kept = self._first(held)
        self.newest.put(kept)
        yield Row(key=str(key[0]), held=len(kept))

    def _first(self, rows: set[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: [(x is not None, x) for x in r[:self.order]], reverse=True)[:self.keep]

    def close(self) -> None:
        pass


def _files(spark: SparkSession, source_dir: str, schema: StructType, files_per_trigger: int | None) -> DataFrame:
    stream = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(source_dir)


def _run(spark: SparkSession, changed: DataFrame, checkpoint_dir: str) -> None:
    """Take every file there is into the state, then stop (``availableNow``). The result is the state itself."""
    with _rocksdb(spark):
        q = (changed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
        q.awaitTermination()


def run_edit_stream(spark: SparkSession, source_dir: str, schema: StructType, checkpoint_dir: str,
                    files_per_trigger: int | None = None, cols: Sequence[str] = EDIT_COLS) -> None:
    """The newest edit of each animal; ``cols`` begin with what orders edits."""
    edits = _files(spark, source_dir, schema, files_per_trigger)
    _run(spark, edits.groupBy("animal_id").agg(F.max(F.struct(*cols)).alias("newest")), checkpoint_dir)


def read_edit_state(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    with _rocksdb(spark):
        state = spark.read.format("statestore").load(checkpoint_dir)
    return state.select("key.animal_id", "value.max.*")


def run_vaccination_stream(spark: SparkSession, source_dir: str, schema: StructType, known_ids: DataFrame,
                           checkpoint_dir: str, files_per_trigger: int | None = None, keep: int = 2) -> None:
    """Entries that pass the required-field check and name a record go into the state."""
    ok = filters.validate_required(_files(spark, source_dir, schema, files_per_trigger),
                                   ["animal_id", "vaccine", "vaccine_date"]).where("accepted")
    ok = (ok.join(known_ids.select("animal_id").distinct(), "animal_id", "left_semi")
          .withColumn("text", updates.vaccination_text()).select("animal_id", *ENTRY_COLS))
    # Python gives a time of a row and of the state in different forms; a number or its text compare alike.
    ok = ok.withColumn("ts", F.unix_micros("ts") if dict(ok.dtypes)["ts"] == "timestamp" else F.col("ts").cast("string"))
    kinds = {f.name: f for f in ok.schema.fields}
    newest = NewestEntries(StructType([kinds[c] for c in ENTRY_COLS]), len(ORDER), keep)
    _run(spark, ok.groupBy("animal_id").transformWithState(newest, "key string, held int", "Update", "None"), checkpoint_dir)


def read_vaccination_state(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    with _rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint_dir)
    rows = state.select("key.animal_id", "list_element.*")
    return rows.withColumn("ts", F.timestamp_micros("ts") if dict(rows.dtypes)["ts"] == "bigint" else F.col("ts").cast("timestamp_ntz"))
