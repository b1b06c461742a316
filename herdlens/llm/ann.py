"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every task indexes its rows in blocks: for each of m random projections
(rows of random orthonormal bases) the block's projections are sorted. A query
opens a window around its own projection in every array: a range of ranks. A
row collides once per window its rank is in. Virtual rehashing widens all
windows by steps until rows of enough ids of the block pass the collision
threshold; those are verified by their exact inner product. So the share
verified, not their number, is what is set. Rows that pass grow with the step, so the first
step that is enough is looked for from the one the last query ended at.

Largest inner product becomes least distance by one extra component that
brings all rows of a block to one norm; rows far apart in norm are indexed
apart. Queries go in blocks of bounded size against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from herdlens.llm.common import scratch_path, stored
from herdlens.llm.vectors import collected, finite, matrix, own_row, query_blocks

FOUND = StructType().add("query_id", LongType()).add("rank", IntegerType()).add("vec_id", LongType()).add("score", DoubleType())


def projections(dims: int, m: int, seed: int) -> np.ndarray:
    """(dims, m): orthonormal bases side by side, each column of length sqrt(dims)."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-m // dims))]
    return np.concatenate(bases, axis=1)[:, :m] * np.sqrt(dims)


class BlockIndex:
    """Sorted projection arrays over one block of vectors (rows of ``x``), whose ids are ``ids``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, directions: np.ndarray):
        norm = np.sqrt((x * x).sum(1))
        self.norm = norm.max()
        lift = np.sqrt(np.maximum(self.norm ** 2 - norm ** 2, 0))
        p = np.concatenate((x, lift[:, None]), axis=1) @ directions
        order = np.argsort(p, axis=0).T
        self.sorted = np.take_along_axis(p.T, order, 1)
        # Ranks as 16 bits: a block holds fewer than 2**16 rows.
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.uint16)[None, :], 1)
        self.spread = p.std() or 1.0
        self.directions, self.size = directions, len(x)
        one, self.code = np.unique(ids, return_inverse=True)
        self.n_ids = len(one)

    def count(self, rows: np.ndarray) -> int:
        """How many ids ``rows`` have."""
        if self.n_ids == self.size:
            return len(rows)
        return np.count_nonzero(np.bincount(self.code[rows], minlength=self.n_ids))

    def one_each(self, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each id the row with the highest score."""
        if self.n_ids == self.size:
            return rows, scores
        order = np.lexsort((-scores, self.code[rows]))
        first = order[np.unique(self.code[rows[order]], return_index=True)[1]]
        return rows[first], scores[first]

    def search(self, q: np.ndarray, wanted: int, threshold: float, first: float, growth: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows that passed the threshold) for each query: of ``wanted`` ids at least, all rows where that is all ids."""
        if wanted >= self.n_ids:
            yield from ((i, np.arange(self.size)) for i in range(len(q)))
            return
        scale = self.norm / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)
        centre = (np.concatenate((q * scale[:, None], np.zeros((len(q), 1))), axis=1) @ self.directions).T
        m = len(self.rank)
        need = int(np.ceil(threshold * m))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        shifted, hit = np.empty(self.size, np.uint16), np.empty(self.size, bool)

        def passed(query: int, step: int) -> np.ndarray:
            while len(steps) <= step:
                w = first * growth ** len(steps) * self.spread
                low = np.stack([np.searchsorted(s, c - w, side="left") for s, c in zip(self.sorted, centre)], axis=1)
                high = np.stack([np.searchsorted(s, c + w, side="right") for s, c in zip(self.sorted, centre)], axis=1)
                steps.append((low.astype(np.uint16), (high - low).astype(np.uint16)))
            count = np.zeros(self.size, np.uint16)
            for rank, low, width in zip(self.rank, *(side[query] for side in steps[step])):
                np.subtract(rank, low, out=shifted)  # below the window wraps to a large number
                np.less(shifted, width, out=hit)
                np.add(count, hit, out=count)
            return np.flatnonzero(count >= need)

        step = 0
        for i in range(len(q)):
            rows = passed(i, step)
            if self.count(rows) >= wanted:
                while step and self.count(fewer := passed(i, step - 1)) >= wanted:
                    rows, step = fewer, step - 1
            else:
                while self.count(rows) < wanted:
                    step += 1
                    rows = passed(i, step)
            yield i, rows


def _search(held, dims: int, k: int, block_rows: int, m: int, threshold: float, share: float, extra: int, first: float, growth: float, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = held.value
        directions = projections(dims + 1, m, seed)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(query_ids)

        def index(ids: np.ndarray, x: np.ndarray) -> None:
            norm = np.sqrt((x * x).sum(1))
            octave = np.floor(np.log2(norm.max() / norm) + 1e-3)
            own = dict(zip(*(a.tolist() for a in own_row(ids, query_ids)[::-1])))
            for o in np.unique(octave):
                rows = np.flatnonzero(octave == o)
                wanted = int(share * len(rows)) + extra * k
                block = BlockIndex(x[rows], ids[rows], directions)
                for i, found in block.search(q, wanted, threshold, first, growth):
                    if i in own:
                        found = found[ids[rows[found]] != query_ids[i]]
                    # An id's repeated rows count once, with the highest score, before the cut.
                    found, scores = block.one_each(found, x[rows[found]] @ q[i])
                    s, who = best[i]
                    s, who = np.concatenate((s, scores)), np.concatenate((who, ids[rows[found]]))
                    # What is held are k ids at most, so 4k rows have 3k ids at least.
                    if len(s) > 4 * k:
                        cut = np.partition(s, len(s) - 4 * k)[len(s) - 4 * k]
                        s, who = s[s >= cut], who[s >= cut]
                    order = np.lexsort((who, -s))
                    s, who = s[order], who[order]
                    one = np.sort(np.unique(who, return_index=True)[1])[:k]
                    best[i] = s[one], who[one]

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            parts.append((b.column(0).to_numpy(), matrix(b.column(1), dims)))
            if sum(len(p[0]) for p in parts) >= block_rows:
                ids, x = (np.concatenate(c) for c in zip(*parts))
                full = len(ids) - len(ids) % block_rows
                for i in range(0, full, block_rows):
                    index(ids[i:i + block_rows], x[i:i + block_rows])
                parts = [(ids[full:], x[full:])]
        if parts and sum(len(p[0]) for p in parts):
            index(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, [len(s) for s, _ in best])), pa.array(np.concatenate([w for _, w in best])),
                                          pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return scan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = 4096, block_rows: int = 16_384, m: int = 65,
            threshold: float = 0.75, share: float = 0.07, extra: int = 10, first: float = 1.0, growth: float = 1.05, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query, ties to smaller ids.

    ``vectors`` (vec_id, v) and ``queries`` (query_id, q) hold arrays of
    doubles; a row with the query's id is the query's own. In every block of
    rows, as many ids as ``share`` of the rows and ``extra * k`` more are
    verified; blocks with fewer ids are searched whole. Repeated rows of an id
    count once, with their highest score; exact copies go first. Shorter vectors count as padded with zeros. No rows give no rows.
    """
    spark = vectors.sparkSession
    dims = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, queries.agg(F.max(F.size("q"))).first()[0] or 0, 1)
    vectors = stored(vectors.select("vec_id", "v").distinct(), "ann-vectors")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found_at = scratch_path(spark, "ann-best")
    blocks = 0
    for block in query_blocks(queries, query_block):
        held = spark.sparkContext.broadcast(collected(block, dims))
        found = vectors.select("vec_id", "v").mapInArrow(_search(held, dims, k, block_rows, m, threshold, share, extra, first, growth, seed),
                                                         "query_id long, vec_id long, score double")
        # Tasks give k rows a query at most; ids repeated over tasks count once.
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = one.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        best.select(*FOUND.names).write.parquet(f"{found_at}/block={blocks}")
        blocks += 1
        held.unpersist()
    # One scan of all blocks' results, however many there are.
    return spark.read.schema(FOUND).parquet(found_at).select(*FOUND.names) if blocks else spark.createDataFrame([], FOUND)


def op5_query(table: DataFrame, every: int = 20) -> DataFrame:
    v = F.col("embedding")
    rows = (table.where(F.col("vec_id").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest(rows, queries, 20)
