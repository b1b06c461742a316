"""Parallel scan of CSV files whose quoted text holds line breaks.

A line starts a record if an even number of quotes stands before it in its
file. Quotes are counted by chunk, a run of at most ``CHUNK_LINES`` lines of a
split; the counts are summed up in file order (as many rows as chunks), and lines
of a chunk meet in one exchange, where running sums deal them to records. Records
that lie in one chunk are whole there; only the pieces at chunk ends are grouped
once more. So a file is read by as many tasks as it has splits, and a task after
the exchange gets chunks by AQE's target size, however large splits are. Files follow RFC 4180: quotes stand only around
a value, and inside it they are doubled. A file whose quotes don't pair up is
refused. Line breaks inside a value stay as they are in the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdlens.sources.tables import stored

#: Lines of a split that are dealt out together.
CHUNK_LINES = 4096


def _text(pieces: str) -> Column:
    """Pieces collected as (place, text), joined in order."""
    return F.array_join(F.transform(F.array_sort(F.col(pieces)), lambda x: x["text"]), "\n").alias("text")


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, block, chunk, record, heads, text): each record's whole text, found from the quotes.

    ``block`` is the start of the split that holds the record's first line, ``chunk``
    the run of lines in it and ``record`` its number there, from 1. ``heads``: it is
    the file's first record. Empty records are left out.
    """
    value = F.col("value")
    line = F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        line.alias("line"), value,
        ((F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2).alias("odd"))
    # The low 33 bits of a line's id count up in its task, so in its split.
    lines = lines.withColumn("chunk", F.floor(F.col("line").bitwiseAND((1 << 33) - 1) / CHUNK_LINES))
    unit = ["file", "block", "chunk"]
    in_file = Window.partitionBy("file")
    by_place = in_file.orderBy("block", "chunk")
    blocks = (lines.groupBy(*unit).agg(F.sum("odd").alias("quotes"))
              .withColumns({"all_quotes": F.sum("quotes").over(in_file), "upto": F.sum("quotes").over(by_place),
                            "heads": F.row_number().over(by_place) == 1}))
    refuse = F.raise_error(F.concat(F.lit("quotes don't pair up in "), F.col("file"))).cast("bigint")
    before = F.when(F.col("all_quotes") % 2 == 1, refuse).otherwise(F.col("upto") - F.col("quotes"))
    blocks = blocks.select(*unit, before.alias("before"), (F.col("upto") % 2 == 1).alias("left_open"), "heads")

    in_chunk = Window.partitionBy(*unit).orderBy("line")
    so_far = F.col("before") + F.sum("odd").over(in_chunk) - F.col("odd")
    dealt = (lines.join(blocks, unit).withColumn("starts", (so_far % 2 == 0).cast("int"))
             .withColumn("record", F.sum("starts").over(in_chunk)))
    # The window's exchange by (file, block, chunk) serves this grouping too.
    pieces = stored(dealt.groupBy(*unit, "record")
                    .agg(F.collect_list(F.struct(F.col("line").alias("place"), F.col("value").alias("text"))).alias("lines"),
                         F.first("left_open").alias("left_open"), F.first("heads").alias("heads"))
                    .select(*unit, "record", "left_open", "heads", _text("lines")), "csv-records")

    # A piece without a start (record 0) goes on with the last record of the nearest chunk before that has one.
    ends = pieces.groupBy(*unit).agg(F.max("record").alias("last"), F.first("heads").alias("heads"))
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct("block", "chunk", "last", "heads")), ignorenulls=True).over(earlier)
    ends = ends.select(*unit, "last", owner.alias("owner"))
    cut = pieces.join(ends, unit)
    crossing = (F.col("record") == 0) | (F.col("left_open") & (F.col("record") == F.col("last")))
    whole = cut.where(~crossing).select(*unit, "record", "heads", "text")
    own = F.struct("block", "chunk", F.col("record").alias("last"), "heads")
    joined = (cut.where(crossing).withColumn("of", F.when(F.col("record") == 0, F.col("owner")).otherwise(own))
              .groupBy("file", "of").agg(F.collect_list(F.struct(F.struct("block", "chunk").alias("place"), "text")).alias("lines"))
              .select("file", "of.block", "of.chunk", F.col("of.last").alias("record"), "of.heads", _text("lines")))
    return (whole.unionByName(joined).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
            .withColumn("heads", F.col("heads") & (F.col("record") == 1)).where(F.col("text") != ""))


def read_split_csv(spark: SparkSession, path: str, header: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Rows of header CSV files as text columns named by ``header``; each file's first line is its header."""
    rows = quoted_records(spark, path).where(~F.col("heads"))
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = rows.select(F.from_csv("text", F.lit(schema), {**options, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(header)])
