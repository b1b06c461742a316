"""Hilbert-curve sharding: order documents along a space-filling curve over metadata, cut equal runs.

Several metadata columns are quantised to a few bits each, the cell's place
on the Hilbert curve is the sort key, and the sorted sequence is cut into
runs. Files of one run then cover a compact box of the metadata space, so the
min/max statistics of each file prune on any of the dimensions. The law is
``rows``: shard sizes differ by one row at most, whatever the skew, because
the cut is by position and a hot cell is split by the tie-breaking columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import ranked, small, stored


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points, ``coords`` (dims, n) below 2**bits.

    The transpose form of the curve: undo the excess rotations from the top
    bit down, Gray-encode, and interleave the bits of the dimensions.
    """
    x = coords.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_bit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


#: A row's unique place, which ``shard`` carries through.
ROW = "_row"
#: A text column with fewer distinct values than this has its ranks broadcast.
BROADCAST_VALUES = 100_000


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs``, stored, with a unique ``_row``: what texts join their places by, whatever the ids."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "shard-rows")


def _text_ranks(t: DataFrame, name: str) -> DataFrame:
    """The text column ``name`` as the rank of its whole value among the distinct values; null stays null."""
    values = ranked(t.select(F.col(name).alias("_value")).where("_value IS NOT NULL").distinct(), [F.col("_value")], "shard-values", "_rank")
    values = small(values, values.count(), BROADCAST_VALUES)
    return t.join(values, F.col(name) == F.col("_value"), "left").withColumn(name, F.col("_rank").cast("double")).drop("_value", "_rank")


def shard(docs: DataFrame, dims: dict[str, Column], ties: list[str], n_shards: int = 24, bits: int = 8) -> DataFrame:
    """Rows of ``docs`` with ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in each shard).

    ``dims`` are numbers or text, which counts by the rank of its whole value
    among the column's distinct values. Each is quantised at up to
    ``2**bits - 1`` approximate quantiles of the whole column (bounded, whatever
    the size), null lowest. ``ties`` order the rows of one cell. Keep ``docs``
    narrow: it is stored and exchanged; texts join back by ``_row`` to be written
    (``with_rows``, ``write_shards``).
    Empty tables give empty tables; repeated rows each get a place of their own.
    """
    names = list(dims)
    t = stored(docs.withColumns({f"_d{i}": dims[n] for i, n in enumerate(names)}), "shard-meta")
    for name, kind in t.dtypes[-len(names):]:
        t = _text_ranks(t, name) if kind == "string" else t.withColumn(name, F.col(name).cast("double"))
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = t.agg(*[F.percentile_approx(f"_d{i}", steps, 1 << (bits + 4)).alias(f"c{i}") for i in range(len(names))]).first()
    edges = [np.unique(np.asarray(c if c is not None else [], dtype=float)) for c in cuts]

    @F.pandas_udf("long")
    def curve(cols: pd.DataFrame) -> pd.Series:
        cells = []
        for i, e in enumerate(edges):
            v = cols.iloc[:, i].to_numpy(dtype=float, na_value=-np.inf)
            cells.append(np.searchsorted(e, np.where(np.isnan(v), -np.inf, v), side="left"))
        return pd.Series(hilbert_index(np.stack(cells), bits))

    t = t.withColumn("_curve", curve(F.struct(*[f"_d{i}" for i in range(len(names))])))
    r = ranked(t, [F.col("_curve"), *[F.col(c) for c in ties]], "shard-order", "_position")
    n = t.count()
    # Shard s starts at ceil(s * n / n_shards), so sizes differ by one at most.
    cut = F.expr(f"_position * {n_shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return (r.withColumn("shard", cut.cast("int")).withColumn("slot", F.col("_position") - start)
            .withColumnRenamed("_curve", "curve")
            .drop("_position", *[f"_d{i}" for i in range(len(names))]))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole documents into one folder per shard, in slot order, each row once.

    ``docs`` come from ``with_rows`` and ``placed`` from ``shard`` over columns
    of the same ``docs`` with their ``_row``.
    """
    (docs.join(placed.select(ROW, "shard", "slot"), ROW).drop(ROW)
     .repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op9_query(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.col("text"), "utf-8")
    meta = docs.select("doc_id", "source", "lang",
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"))
    dims = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "size": F.col("size").cast("double")}
    placed = shard(meta, dims, ties=["size", "text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")
