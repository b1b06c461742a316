"""Corpus pipeline over ``documents``: stages of the training-data operators, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from herdlens.llm import line_dedup, mixing, packing, quality, simhash
from herdlens.llm.common import passing_scratch, scratch_path, ship
from herdlens.sources.tables import read_table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.without_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    ship(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place; a document emitted twice by the mix is packed twice."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", one_of_each_group),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all ``documents``, each written as Parquet and reread; what a stage stored on its way is then deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with passing_scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
