"""Record-table sources and sinks.

* CSV scan by header name with the pandas missing-value tokens (S1), resolved
  from a list of candidate paths (S2), a check of the header for required
  columns (S3) and optional-column backfill (S4).
* Table save (S5): each save is a new version of its own, a plain Spark table
  bucketed by the record key; the newest version is the table.
* Report sink (S6): report rows written partitioned by a hash of the key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from herdlens.fixed_values import PANDAS_NA_TOKENS, RECORD_HEADERS
from herdlens.sources.split_csv import read_split_csv


# --- Hadoop file-system helpers (driver-side metadata calls only) ---

def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first candidate path that exists, else an error naming all of them."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError("record table not found at any of: " + ", ".join(paths))


# --- S1 / S3 / S4 ---

def read_records_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
                     na_tokens: Sequence[str] = PANDAS_NA_TOKENS, names: dict[str, str] | None = None,
                     required: Sequence[str] = (), multi_line: bool = True, parallel: bool = False) -> DataFrame:
    """Header CSV read by column name, every column as text; NA tokens and '' -> null.

    Quotes inside quoted text are doubled, and with ``multi_line`` quoted text
    may hold line breaks; a file is then read by one task, unless ``parallel``
    finds the records by their quotes (``split_csv``: quotes must pair up as in
    RFC 4180, and a file's first line is its header). ``names`` maps header names to column
    names (default: the record file's own headers). Columns in ``required``
    must be in the header (S3); other ``columns`` it lacks come back null.
    All files of a folder share the first one's header.
    """
    path = paths if isinstance(paths, str) else first_existing(spark, list(paths))
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quote": '"', "escape": '"'}
    df = spark.read.options(**options).option("header", True).option("inferSchema", False).option("multiLine", multi_line).csv(path)
    if parallel:
        df = read_split_csv(spark, path, df.columns, options)
    known = RECORD_HEADERS if names is None else names
    df = df.select(*[F.col(f"`{c}`").alias(known.get(c, c)) for c in df.columns])
    require_columns(df, required)
    tokens = list(na_tokens)
    wanted = list(columns) if columns is not None else df.columns
    return df.select(*[
        F.when(~(F.col(c).isin(*tokens) | (F.col(c) == F.lit(""))), F.col(c)).alias(c)
        if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def write_records_csv(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """Header CSV with doubled quotes; ``headers`` renames columns to header names."""
    out = df.select(*[F.col(c).alias((headers or {}).get(c, c)) for c in df.columns])
    (out.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


class MissingColumns(KeyError):
    pass


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """S3: raise naming the required columns when one is absent; else pass through."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"Missing column: {missing[0]}. Required: {list(required)}")
    return df


def required_columns_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """S3 as data: (column_name, present, non_null) in one aggregation pass."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in present]) if present else None
    rows = []
    for i, c in enumerate(required, start=1):
        n = F.col(c) if c in present else F.lit(0).cast("bigint")
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name"),
                             F.lit(c in present).alias("present"), n.alias("non_null")))
    base = counts if counts is not None else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*rows)))


def backfill_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add each absent column with its constant; present columns are untouched."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


# --- S5: saved tables ---

def table_versions(spark: SparkSession, name: str) -> list[int]:
    """Versions of a saved table, ascending."""
    found = [re.fullmatch(re.escape(name) + r"_v(\d+)", t.name) for t in spark.catalog.listTables()]
    return sorted(int(m[1]) for m in found if m)


def save_table(df: DataFrame, name: str, key: str = "animal_id", buckets: int = 64, path: str | None = None) -> str:
    """Save ``df`` as the next version of ``name``; returns the version's table name.

    A version is a plain Spark table, bucketed and sorted by ``key``, so that a
    merge into it moves the changes only. It goes to the warehouse, or below
    ``path``. A version is never written over: of two writers one fails.
    """
    spark = df.sparkSession
    table = f"{name}_v{max(table_versions(spark, name), default=0) + 1}"
    writer = df.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", f"{path.rstrip('/')}/{table}")).saveAsTable(table)
    return table


def current_table(spark: SparkSession, name: str) -> DataFrame:
    versions = table_versions(spark, name)
    if not versions:
        raise FileNotFoundError(f"no saved version of {name}")
    return spark.table(f"{name}_v{versions[-1]}")


def retire_versions(spark: SparkSession, name: str, keep: int = 2) -> None:
    """Drop all but the newest ``keep`` versions."""
    for v in table_versions(spark, name)[:-keep or None]:
        spark.sql(f"DROP TABLE IF EXISTS {name}_v{v}")


# --- S6: report sink ---

def write_reports(df: DataFrame, path: str, key: str = "animal_id", buckets: int | None = None,
                  rows_per_bucket: int = 1_000_000) -> None:
    """Report rows as JSON, partitioned by a hash bucket of the key (not one file per key).

    Buckets follow the row count unless given; each is written by its own task.
    """
    if buckets is None:
        buckets = max(8, -(-df.count() // rows_per_bucket))
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    (df.withColumn("key_bucket", bucket)
     .repartition(buckets, "key_bucket")
     .write.mode("errorifexists").partitionBy("key_bucket").json(path))


def read_reports(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path).drop("key_bucket")
