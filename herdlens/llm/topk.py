"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of partial scores, one per slice of the components; every
task holds its rows' list of partial scores for each slice.

1. Each list gives its k best entries for each query. Their exact totals give
   tau, the k-th best total so far: a safe lower bound of the true k-th score.
2. tau / lists is broadcast. A row that scores tau in all scores at least that
   in some list, so every list sends its entries from there up; ties included.
3. Entries of one row are added up, lists that sent nothing count as the
   cutoff, rows whose bound falls short are pruned, and the rest is resolved
   exactly in long arithmetic and ranked.

Queries go in blocks of bounded size against all rows; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from herdlens.llm.common import scratch_path, stored
from herdlens.llm.vectors import collected, finite, matrix, own_row, query_blocks

FOUND = StructType().add("query_id", LongType()).add("rank", IntegerType()).add("vec_id", LongType()).add("score", LongType())
_ROWS = 1024  # rows compared at a time


def _slices(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _chunks(batches: Iterator[pa.RecordBatch], dims: int):
    for b in batches:
        ids, x = b.column(0).to_numpy(), matrix(b.column(1), dims)
        for i in range(0, len(ids), _ROWS):
            yield ids[i:i + _ROWS], x[i:i + _ROWS]


def _best_of_lists(held, dims: int, lists: int, k: int):
    """Phase 1: each task's k best entries per query and list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = held.value
        parts = _slices(dims, lists)
        best = np.full((lists, len(query_ids), k), -np.inf)
        who = np.zeros((lists, len(query_ids), k), np.int64)
        for ids, x in _chunks(batches, dims):
            row, col = own_row(ids, query_ids)
            own = np.unique(ids)
            order = np.argsort(ids, kind="stable")
            at = np.searchsorted(ids[order], own)
            for n, s in enumerate(parts):
                p = q[:, s] @ x[:, s].T
                p[col, row] = -np.inf
                p = np.maximum.reduceat(p[:, order], at, axis=1)  # an id's best row stands for it
                # The best entries of the chunk join the best so far, one an id.
                top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                v = np.concatenate((best[n], np.take_along_axis(p, top, 1)), axis=1)
                w = np.concatenate((who[n], own[top]), axis=1)
                down = np.argsort(-v, axis=1, kind="stable")
                v, w = np.take_along_axis(v, down, 1), np.take_along_axis(w, down, 1)
                v[np.tril((w[:, :, None] == w[:, None, :]) & (v > -np.inf)[:, None, :], -1).any(axis=2)] = -np.inf
                keep = np.argsort(-v, axis=1, kind="stable")[:, :k]
                best[n], who[n] = np.take_along_axis(v, keep, 1), np.take_along_axis(w, keep, 1)
        n, i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(n.astype(np.int32)), pa.array(who[n, i, j]), pa.array(best[n, i, j])],
                                         names=["query_id", "list", "vec_id", "part"])

    return scan


def _sufficient(held, dims: int, lists: int):
    """Phase 2: every entry at or above the query's cutoff."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, cutoff = held.value
        parts = _slices(dims, lists)
        for ids, x in _chunks(batches, dims):
            row, col = own_row(ids, query_ids)
            for n, s in enumerate(parts):
                p = q[:, s] @ x[:, s].T
                # Sums of doubles may be off by a little; only what is surely below stays out.
                slack = 1e-12 * np.abs(q[:, s]).sum(1) * (np.abs(x[:, s]).max() if x[:, s].size else 0)
                p[col, row] = -np.inf
                i, j = np.nonzero((p >= (cutoff - slack)[:, None]) & (p > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(ids[j]), pa.array(p[i, j] + slack[i])],
                                                 names=["query_id", "vec_id", "part"])

    return scan


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 2, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids.

    ``vectors`` (vec_id, v) and ``queries`` (query_id, q) hold arrays of longs;
    a row with the query's id is the query's own. Equal rows count once; of the
    others of an id the highest score counts (queries: the smallest vector). The
    lists hold one entry an id, so a hot id leaves no query without a cutoff
    unless there are fewer than k candidates, which all are sent then. Shorter
    vectors count as padded with zeros. Scores are longs; what does not fit
    raises. Fewer candidates than k give all of them; no rows give no rows.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.select("vec_id", "v").distinct(), "topk-rows")
    dims = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, queries.agg(F.max(F.size("q"))).first()[0] or 0, lists)

    def resolved(pairs: DataFrame, block: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
        # A query block is bounded by query_block rows.
        return (pairs.join(vectors, "vec_id").join(F.broadcast(block), "query_id")
                .groupBy("query_id", "vec_id").agg(F.max(product).alias("score")))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found_at = scratch_path(spark, "topk-best")
    blocks = 0
    for block in query_blocks(queries, query_block):
        query_ids, q = collected(block, dims)
        held = spark.sparkContext.broadcast((query_ids, q))
        lists_best = vectors.select("vec_id", "v").mapInArrow(_best_of_lists(held, dims, lists, k), "query_id long, list int, vec_id long, part double")
        place = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id"))
        lists_best = lists_best.groupBy("query_id", "list", "vec_id").agg(F.max("part").alias("part"))
        first = stored(lists_best.withColumn("n", place).where(F.col("n") <= k).select("query_id", "vec_id").distinct(), "topk-first")
        tau = resolved(first, block).withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k)
        tau = {r["query_id"]: float(r["score"]) for r in tau.select("query_id", "score").collect()}
        cutoff = np.array([tau.get(int(i), -np.inf) for i in query_ids])
        held2 = spark.sparkContext.broadcast((query_ids, q, cutoff / lists))
        sent = vectors.select("vec_id", "v").mapInArrow(_sufficient(held2, dims, lists), "query_id long, vec_id long, part double")
        bounds = spark.createDataFrame([(int(i), float(c)) for i, c in zip(query_ids, cutoff)], "query_id long, tau double")
        # Repeated rows of an id send each list's entry more than once: the sum is then an even safer bound.
        bound = F.col("total") + F.greatest(lists - F.col("n"), F.lit(0)) * F.col("tau") / lists
        left = (sent.groupBy("query_id", "vec_id").agg(F.sum(F.greatest("part", F.lit(0.0))).alias("high"), F.sum("part").alias("sum"), F.count(F.lit(1)).alias("n"))
                .withColumn("total", F.when(F.col("n") > lists, F.col("high")).otherwise(F.col("sum")))
                .join(F.broadcast(bounds), "query_id").where((F.col("tau") == float("-inf")) | (F.col("n") > lists) | (bound >= F.col("tau") - F.abs("tau") * 1e-12))
                .select("query_id", "vec_id"))
        best = resolved(left, block).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        best.select(*FOUND.names).write.parquet(f"{found_at}/block={blocks}")
        blocks += 1
        held.unpersist()
        held2.unpersist()
    # One scan of all blocks' results, however many there are.
    return spark.read.schema(FOUND).parquet(found_at).select(*FOUND.names) if blocks else spark.createDataFrame([], FOUND)


def op2_query(table: DataFrame, every: int = 50) -> DataFrame:
    rows = (table.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return top_k(rows, queries, 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
