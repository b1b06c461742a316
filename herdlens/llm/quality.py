"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A document's features are its words, the character n-grams of each word with
its boundaries, and neighbouring word pairs, all hashed to a fixed number of
buckets. Each bucket has a learned vector; a document is the average of its
features' vectors, and a softmax over two outputs gives the score. Training
runs in one task on a bounded sample of labelled rows (``max_rows``); scoring
is linear in the averaged vectors, so every bucket shrinks to one number
and all documents are scored in one scan without a shuffle.

Features are computed over arrays of code points: a polynomial prefix hash
gives the hash of every word and n-gram of a block by subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored, text_of

BITS = 18
GRAMS = (2, 3, 4)
#: Characters handled at a time; longer texts go in several blocks.
BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK + 1024), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BITS)).astype(np.int64)


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of words between single spaces, the place each block's parts start at, their texts, and which
    parts go on with a text: (codes, starts, owners, carried). Such a part starts with the last word before it."""
    parts, owners, carried, size = [], [], [], 0
    for k, t in enumerate(texts):
        words = t.split()
        step = max(1, BLOCK * len(words) // max(len(t), 1)) if len(t) > BLOCK else len(words) or 1
        for i in range(0, len(words), step):
            part = " ".join(words[max(i - 1, 0):i + step])
            if size and size + len(part) > BLOCK:
                yield _codes(parts, owners, carried)
                parts, owners, carried, size = [], [], [], 0
            parts.append(part)
            owners.append(k)
            carried.append(i > 0)
            size += len(part) + 2
    if parts:
        yield _codes(parts, owners, carried)


def _codes(parts: list[str], owners: list[int], carried: list[bool]):
    codes = np.frombuffer(("  ".join(["", *parts, ""])[1:-1]).encode("utf-32-le", "replace"), "<u4")
    starts = np.concatenate(([0], np.cumsum([len(p) + 2 for p in parts])[:-1]))
    return codes, starts, np.array(owners), np.array(carried)


def features(codes: np.ndarray, starts: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, part) of every feature of a block; ``starts`` are the parts' leading spaces. Of a ``carried`` part's
    first word only the pair with the next one counts."""
    n = len(codes)
    space = codes == 32
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * _power(_BASE, n), dtype=np.uint64)))
    back = _power(_INVERSE, n)
    part = np.zeros(n, np.int32)
    part[starts[1:]] = 1
    part = np.cumsum(part, dtype=np.int32)
    edge = np.flatnonzero(space)
    word = np.flatnonzero(np.diff(edge) > 1)
    first, last = edge[word] + 1, edge[word + 1]
    h = (prefix[last] - prefix[first]) * back[first]
    counted = np.ones(n, bool)
    if carried.any():
        for a, b in zip(first[known := np.isin(first, starts[carried] + 1)], last[known]):
            counted[a - 1:b] = False
    new = counted[first]
    out, of = [_bucket(h[new], 1)], [part[first[new]]]
    # A pair's hash is the difference of its words' hashes, so all repeats of a word share one bucket.
    near = np.flatnonzero(part[first[1:]] == part[first[:-1]])
    out.append(_bucket(h[near + 1] - h[near], 2))
    of.append(part[first[near]])
    inside = np.cumsum(space, dtype=np.int32)
    for k in GRAMS:
        if n < k:
            continue
        # No space but at either end, and not two ends of nothing.
        ok = np.flatnonzero(inside[k - 2:n - 1] == inside[:n - k + 1]) if k > 2 else np.flatnonzero(~(space[:-1] & space[1:]))
        ok = ok[counted[ok]]
        out.append(_bucket((prefix[ok + k] - prefix[ok]) * back[ok], 2 + k))
        of.append(part[ok])
    return np.concatenate(out), np.concatenate(of)


def score_texts(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for codes, starts, owners, carried in blocks(texts):
        bucket, part = features(codes, starts, carried)
        total += np.bincount(owners[part], weight[bucket], len(texts))
        count += np.bincount(owners[part], minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 8, rate: float = 0.5,
          seed: int = 1, min_steps: int = 12_000) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from (buckets, counts, label) rows, by SGD over a softmax of averaged vectors.

    Small samples are gone over more often, so that ``min_steps`` are taken.
    """
    if not rows:
        return np.zeros(1 << BITS, np.float32), 0.0
    epochs = max(epochs, -(-min_steps // len(rows)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out = np.zeros((2, dim + 1), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, counts, label = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            share = counts / max(counts.sum(), 1)
            hidden = np.append(share @ vectors[buckets], np.float32(1))
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out[:, :dim]
            out -= lr * np.outer(p, hidden)
            vectors[buckets] -= np.outer((lr * len(buckets) ** 0.5) * share, back)
    gap = out[1] - out[0]
    return vectors @ gap[:dim], float(gap[dim])


# ---------------------------------------------------------------- on Spark


def fold(key: Column) -> Column:
    """crc32 of the id as text, mod 5; the fold 0 is held out."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_rows: int = 2000, **params) -> tuple[np.ndarray, float]:
    """Bucket weights and bias, learned from at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is the rows with the smallest md5 of their id. Their texts'
    features are counted where the texts are; only the counts reach the one
    training task. With no labelled row every text scores one half.
    """
    chosen = (labels.where((fold(F.col(key)) != 0) & F.col(label).isin(0, 1))
              .select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
              .orderBy(F.md5(F.col("_id").cast("string")), "_id", "_label").limit(max_rows))
    chosen = stored(chosen, "quality-sample")
    sample = docs.select(F.col(key).cast("long").alias("_id"), text_of(docs, text).alias("_text"))
    sample = sample.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(2).to_pylist():
                found = [features(codes, starts, carried)[0] for codes, starts, _, carried in blocks([t])]
                u, c = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
                at.append(u.astype("<i4").tobytes())
                n.append(c.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                             names=["_id", "_label", "buckets", "counts"])

    # One row per sampled id and label, so repeated rows of an id don't pass the bound; of several texts the smallest features.
    counted = stored(sample.mapInArrow(count, "_id long, _label int, buckets binary, counts binary").groupBy("_id", "_label")
                     .agg(F.min(F.struct("buckets", "counts")).alias("f")).select("_id", "_label", "f.*"), "quality-features")

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_id", "_label"])
        rows = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<f4"), int(y)) for b, c, y in zip(g["buckets"], g["counts"], g["_label"]) if len(b)]
        weight, bias = train(rows, **params)
        return pd.DataFrame([{"weight": weight.astype("<f4").tobytes(), "bias": bias}])

    model = counted.groupBy().applyInPandas(learn, "weight binary, bias double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model[0]["weight"], "<f4"), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``_score`` in 0..1; null text is empty, and an empty text's score is the bias's."""
    # One float per bucket: 2**BITS * 4 bytes whatever the corpus.
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = held.value
        weight = weight.astype(np.float64)
        for t in texts:
            yield pd.Series(score_texts(t.tolist(), weight, bias))

    return docs.withColumn("_score", scored(text_of(docs, text)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """``docs`` whose score reaches ``threshold``; columns of any name stay."""
    text = params.get("text", "text")
    rows = docs.select(F.struct(*docs.columns).alias("_record"), F.col(text).alias("text"))
    return score(rows, fit(docs, labels, **params)).where(F.col("_score") >= threshold).select("_record.*")


def op4_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= threshold).cast("int").alias("predicted"))
