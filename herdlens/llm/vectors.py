"""Vector tables: which rows take part, bounded query blocks, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored


def finite(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are padded with zeros."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if len(sizes) and (sizes == dims).all():
        return values[at[0]:at[-1]].reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = values[at[0]:at[-1]]
    return out


def query_blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    """Queries (query_id, q), one row per id, in blocks of about ``block`` rows: what is broadcast at a time."""
    one = stored(queries.groupBy("query_id").agg(F.min("q").alias("q")), "vector-queries")
    n = -(-one.count() // block)
    for b in range(n):
        yield one.where(F.expr(f"pmod(xxhash64(query_id), {n})") == b)


def collected(block: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a query block, sorted by id; bounded by the block's size."""
    rows = block.orderBy("query_id").collect()
    return np.array([r["query_id"] for r in rows], np.int64), matrix(pa.array([r["q"] for r in rows], pa.list_(pa.float64())), dims)


def own_row(ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) places where a row is the query itself; ``query_ids`` sorted."""
    at = np.minimum(np.searchsorted(query_ids, ids), len(query_ids) - 1)
    row = np.flatnonzero(query_ids[at] == ids)
    return row, at[row]
