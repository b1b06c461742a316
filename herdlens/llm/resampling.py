"""Target-distribution importance resampling with a head-tail vocabulary.

A document's features are its words and pairs of consecutive words; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``. Three passes:

1. *Head.* Every task counts its words and pairs and reports those that make
   up a fixed share of it, so a report has a bounded size and no frequent
   feature is missed. The most frequent become the head: for each word the
   exact CRC state after it and after the space that follows, for each pair of
   head words its bucket. The head is broadcast; its size is bounded by
   ``head_words`` and ``head_pairs``. It only saves work: results are the same
   with any head.
2. *Totals.* Head features are looked up; the others, the tail, take their CRC
   directly, pairs from the state of their first word. Both add to exact
   totals of each bucket over all documents and over the target texts.
3. *Weights.* The same lookup sums the gains of a document's buckets. Ranks
   come from a range-partitioned order of ids and scores, without the texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import ranked, stored, text_of

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a block of texts that are looked up at a time.
BLOCK = 1 << 18
#: A task reports words that make up 1 of so many of its words, pairs 1 of so many of its pairs.
WORD_SHARE, PAIR_SHARE = 1 << 16, 1 << 14


class Head:
    """Frequent words with their exact CRC states, and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.at = {w: i for i, w in enumerate(words)}
        self.end = np.array([zlib.crc32(w) for w in words], np.int64)
        self.space = np.array([zlib.crc32(w + b" ") for w in words], np.int64)
        keys = np.array([self.at[a] * len(words) + self.at[b] for a, b in pairs if a in self.at and b in self.at], np.int64)
        found = np.array([zlib.crc32(a + b" " + b) % buckets for a, b in pairs if a in self.at and b in self.at], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_buckets = keys[order], found[order]

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the first text, words of each text, buckets of all features' texts in order) in blocks.

        A text longer than a block is cut; the pair across the cut goes with the later part.
        """
        words, of, carried = [], [], False
        for k, t in enumerate(texts):
            found = _WORD.findall(t.lower())
            for i in range(0, len(found), BLOCK):
                part = found[max(i - 1, 0):i + BLOCK]
                if words and len(words) + len(part) > BLOCK:
                    yield self._features(words, of, carried)
                    words, of, carried = [], [], False
                carried = carried or i > 0
                words += part
                of += [k] * len(part)
        if words:
            yield self._features(words, of, carried)

    def _features(self, words: list[bytes], of: list[int], carried: bool) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of each feature; ``carried``: the first word was counted with the block before."""
        n, at = len(self.at), self.at
        tail: dict[bytes, int] = {}
        ids = np.array([i if (i := at.get(w)) is not None else n + tail.setdefault(w, len(tail)) for w in words], np.int64)
        end = np.concatenate((self.end, np.array([zlib.crc32(w) for w in tail], np.int64)))
        space = np.concatenate((self.space, np.array([zlib.crc32(b" ", c) for c in end[n:].tolist()], np.int64)))
        of = np.array(of)
        first = np.flatnonzero(of[1:] == of[:-1])
        a, b = ids[first], ids[first + 1]
        pair = np.full(len(first), -1, np.int64)
        if len(self.pair_keys):
            both = np.flatnonzero((a < n) & (b < n))
            key = a[both] * n + b[both]
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[spot] == key
            pair[both[hit]] = self.pair_buckets[spot[hit]]
        rest = np.flatnonzero(pair < 0)
        states = space[a[rest]].tolist()
        pair[rest] = np.array([zlib.crc32(words[j], s) for j, s in zip((first[rest] + 1).tolist(), states)], np.int64) % self.buckets
        single = slice(1 if carried else 0, None)
        return np.concatenate((end[ids[single]] % self.buckets, pair)), np.concatenate((of[single], of[first]))


def find_head(texts: DataFrame, head_words: int, head_pairs: int, buckets: int) -> Head:
    """The most frequent words and pairs of ``texts`` (text binary). Ties by bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, n = Counter(), Counter(), 0

        def thin(c: Counter, least: int) -> Counter:
            return Counter({k: v for k, v in c.items() if v > least})

        for b in batches:
            for t in b.column(0).to_pylist():
                found = _WORD.findall(t.lower())
                n += len(found)
                words.update(found)
                pairs.update(pairwise(found))
                # A feature dropped here has less than half of its share so far.
                if len(words) > 8 * WORD_SHARE:
                    words = thin(words, n // (2 * WORD_SHARE))
                if len(pairs) > 32 * PAIR_SHARE:
                    pairs = thin(pairs, n // (2 * PAIR_SHARE))
        rows = [(w, None, c) for w, c in words.items() if c * WORD_SHARE >= n] + [(*p, c) for p, c in pairs.items() if c > 1 and c * PAIR_SHARE >= n]
        first, second, counts = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(counts, pa.int64())], names=["a", "b", "c"])

    seen = stored(texts.mapInArrow(count, "a binary, b binary, c long").groupBy("a", "b").agg(F.sum("c").alias("c")), "resample-head")
    words = [bytes(r.a) for r in seen.where("b is null").orderBy(F.desc("c"), "a").limit(head_words).select("a").collect()]
    pairs = [(bytes(r.a), bytes(r.b)) for r in seen.where("b is not null").orderBy(F.desc("c"), "a", "b").limit(head_pairs).select("a", "b").collect()]
    return Head(words, pairs, buckets)


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features per bucket over all ``texts`` (text binary); a task gives at most one row a bucket."""
    held = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        total = np.zeros(h.buckets, np.int64)
        for b in batches:
            for bucket, _ in h.blocks(b.column(0).to_pylist()):
                total += np.bincount(bucket, minlength=h.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "c"])

    out = np.zeros(head.buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r.bucket] = r.c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to source) of each bucket."""
    k, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, head: Head, gain: np.ndarray, key: str, text: str) -> DataFrame:
    """(doc_id, words, n_features, weight) per row, stored."""
    held = docs.sparkSession.sparkContext.broadcast((head, gain))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for bucket, of in h.blocks(texts):
                np.add.at(total, of, g[bucket])
                n += np.bincount(of, minlength=len(texts))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            # n features are (n + 1) / 2 words and one pair less.
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((n + 1) // 2), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text_of(docs, text), "utf-8").alias("text"))
    return stored(rows.mapInArrow(scan, "doc_id long, words long, n_features long, weight long"), "resample-weights")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000,
             percent: int = 25, least_words: int = 20, seed: str = "7", head_words: int = 65_536, head_pairs: int = 131_072) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``.

    Of the rows with ``least_words`` words, floor(percent / 100) of them with
    the highest scores get a rank, ties to the smaller id, then the smaller
    weight and number of features; a null id comes last and is hashed as an
    empty one. Null, empty and word-less texts have no features and weight 0.
    Repeated rows have equal scores and a rank each. With an empty target all
    counts of the target are 0; an empty table gives none.
    """
    texts = docs.select(F.encode(text_of(docs, text), "utf-8").alias("text"))
    wanted = target.select(F.encode(text_of(target, target_text), "utf-8").alias("text"))
    head = find_head(texts, head_words, head_pairs, buckets)
    rows = weigh(docs, head, gains(bucket_totals(texts, head), bucket_totals(wanted, head)), key, text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))))
    long = rows.where(F.col("words") >= least_words)
    draw = percent * long.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]
    place = ranked(long, order, "resample-order").withColumn("rank", F.when(F.col("position") < draw, F.col("position") + 1))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    short = rows.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return place.select(*cols).unionByName(short.select(*cols))


def op13_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)
