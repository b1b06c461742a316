"""Scanned ids looked up as they arrive (P11/P12 with P1 and P2 as a stream).

Scans are joined to the first record of their id, which is prepared once. Scans
with a record go to one sink, those without to another with the reason; each
sink has a query and a commit log of its own, so both are exactly-once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from herdlens import fixed_values as FV
from herdlens.operators import filters
from herdlens.sources.tables import stored


def not_found_message(ident: str) -> Column:
    """Why a scan has no record: no id in its text, or no record of that id."""
    return F.coalesce(F.concat(F.lit("No record found for Animal ID "), F.col(ident)), F.lit(FV.NO_ID_STATUS))


def match_scans(scans: DataFrame, first: DataFrame, key: str, mode: str = "digits") -> DataFrame:
    """``scans`` with ``extracted_id`` and the columns of ``first`` (one record an id); null where there is none.

    Records are every id's, not only those a batch asks for: they are neither
    broadcast, which the driver would build, nor copied for spread requests. AQE
    splits the scans of a hot id.
    """
    ident = scans.withColumn("extracted_id", filters.extract_id("scanned_text", mode))
    return filters.lookup(ident, "extracted_id", first.hint("merge"), key, order=None, how="left", spread=1)


def run_scan_stream(spark: SparkSession, source_dir: str, schema: StructType, records: DataFrame, key: str, found_dir: str,
                    missing_dir: str, checkpoint_dir: str, mode: str = "digits", files_per_trigger: int | None = None) -> None:
    """Look up every scan available now, then stop (``availableNow``); ``records`` carry their input order."""
    first = stored(filters.first_records(records, key).where(F.col(key).isNotNull()), "first-records")

    def scans() -> DataFrame:
        stream = spark.readStream.schema(schema)
        if files_per_trigger is not None:
            stream = stream.option("maxFilesPerTrigger", files_per_trigger)
        return match_scans(stream.parquet(source_dir), first, key, mode)

    found = scans().where(F.col(key).isNotNull())
    missing = scans().where(F.col(key).isNull()).select(*schema.names, "extracted_id", not_found_message("extracted_id").alias("message"))
    queries = [df.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint_dir}/{name}").outputMode("append")
               .trigger(availableNow=True).start(path)
               for df, name, path in ((found, "found", found_dir), (missing, "missing", missing_dir))]
    for q in queries:
        q.awaitTermination()
