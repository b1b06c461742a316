"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint holds, for each of 64 bits, whether over half of its
3-word shingles' XXH64 values set it. Equal fingerprints are merged first
(partial minimum of doc_id). Distinct fingerprints that differ in at most
``radius`` bits agree on all but ``radius`` of ``radius + 2`` blocks of bits, so
they meet in a bucket keyed by two equal blocks. A large bucket is split by the
same rule on its remaining bits; what is left then has at most 2**16 distinct
fingerprints, which bounds a task with no cap on anything.

Inside a bucket the fingerprints lie vertically: one bit plane holds one bit
of 64 fingerprints per word. One XOR per plane updates 64 distances, kept in
carry-save counters; words whose lanes all exceed the radius are abandoned.
A bucket gives the edges of a spanning star per linked group, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import small, stored, text_of
from herdlens.llm.components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, chunk: int = 65_536) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text; 0 if it has no words."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    total = len(words) - k + 1
    a, b = starts[:total].tolist(), ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, total, chunk):
        h = np.array([digest(flat[x:y], seed) for x, y in zip(a[i:i + chunk], b[i:i + chunk])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print, fp): a 64-bit hash of the text and the signed long of its fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "print", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("print"),
                       F.encode(text_of(docs, text), "utf-8").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, print long, fp long")


def close_pairs(fp: np.ndarray, ends: np.ndarray, radius: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i < j < ends[i], whose fingerprints differ in at most ``radius`` bits.

    ``fp`` is uint64 sorted by bucket, ``ends[i]`` the end of row i's bucket.
    """
    n = len(fp)
    planes = []
    for b in range(64):
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[:n] = (fp >> np.uint64(b)) & np.uint64(1)
        planes.append(np.packbits(bits, bitorder="little").view(np.uint64))
    asks = np.flatnonzero(ends > np.arange(n) + 1)
    words = (ends[asks] - 1) // 64 - (asks + 1) // 64 + 1
    at = 0
    while at < len(asks):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(words[at:]), chunk, side="right")) + at)
        row = np.repeat(asks[at:upto], words[at:upto])
        first = np.repeat(np.concatenate(([0], np.cumsum(words[at:upto])[:-1])), words[at:upto])
        word = (row + 1) // 64 + np.arange(len(row)) - first
        yield from _compare(fp, planes, row, word, ends, radius)
        at = upto


def _lanes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with the bits low..high-1 set (0 <= low < high <= 64)."""
    return (_ALL >> (np.uint64(64) - (high - low).astype(np.uint64))) << low.astype(np.uint64)


def _compare(fp, planes, row, word, ends, radius):
    over = ~_lanes(np.maximum(row + 1 - 64 * word, 0), np.minimum(ends[row] - 64 * word, 64))
    own = fp[row]
    width = (radius + 1).bit_length()
    count = [np.zeros(len(row), np.uint64) for _ in range(width)]
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        above, equal = np.uint64(0), _ALL
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                above, equal = above | (equal & count[k]), equal & ~count[k]
        over |= above
        if b % 4 == 3:
            live = np.flatnonzero(over != _ALL)
            if len(live) < 0.7 * len(row):
                row, word, own, over = row[live], word[live], own[live], over[live]
                count = [c[live] for c in count]
                if not len(row):
                    return
    live = np.flatnonzero(over != _ALL)
    for part in np.array_split(live, max(1, len(live) >> 14)):
        ask, lane = np.nonzero(np.unpackbits((~over[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield row[part][ask], 64 * word[part][ask] + lane


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (roots only) after uniting rows a[i] and b[i]; roots are the smallest rows."""
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _block(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)


def _pair_keys(fp: Column, low: list[int], width: list[int], keep: int) -> Column:
    """Array of keys: which ``keep`` blocks, and their values."""
    keys = []
    for n, chosen in enumerate(combinations(range(len(low)), keep)):
        key = F.lit(n).cast("long")
        for c in chosen:
            key = F.shiftleft(key, width[c]).bitwiseOR(_block(fp, low[c], width[c]))
        keys.append(key)
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 2, split_over: int = 2048) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column ``fp``) that join all that differ in at most ``radius`` bits.

    ``radius`` is 2 or less. Two of four 16-bit blocks are equal then; in a bucket
    of over ``split_over`` rows also two of the four bytes of the other blocks.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    fp = F.col("fp")
    rows = fps.select("fp", F.explode(_pair_keys(fp, [0, 16, 32, 48], [16] * 4, 2)).alias("slot"))
    full = stored(rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over).select("slot"), "simhash-full")
    few = rows.join(full, "slot", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    # The bytes outside the slot's two blocks, by which two blocks those are.
    rest = F.element_at(F.array(*[_pair_keys(fp, [x for c in range(4) if c not in chosen for x in (16 * c, 16 * c + 8)], [8] * 4, 2)
                                  for chosen in combinations(range(4), 2)]), (F.shiftright("slot", 32) + 1).cast("int"))
    many = rows.join(full, "slot", "left_semi").withColumn("sub", F.explode(rest))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(table: np.ndarray) -> pa.RecordBatch:
            new = np.any(table[1:, :2] != table[:-1, :2], axis=1)
            cut = np.concatenate((np.flatnonzero(new) + 1, [len(table)]))
            ends = cut[np.searchsorted(cut, np.arange(len(table)), side="right")]
            f = table[:, 2].copy()
            parent = np.arange(len(f))
            for a, b in close_pairs(f.view(np.uint64), ends, radius):
                parent = _join_up(parent, a, b)
            moved = np.flatnonzero(parent != np.arange(len(f)))
            return pa.RecordBatch.from_arrays([pa.array(f[moved]), pa.array(f[parent[moved]])], names=["u", "v"])

        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)))
            if len(held) < 1 << 16:
                continue
            # The last bucket may go on in the next batch.
            last = len(held) - int(np.argmax(np.any(held[::-1, :2] != held[-1, :2], axis=1))) if np.any(held[:, :2] != held[-1, :2]) else 0
            if last:
                yield edges(held[:last])
                held = held[last:]
        if len(held):
            yield edges(held)

    units = few.unionByName(many).select("slot", "sub", "fp")
    return (units.repartition("slot", "sub").sortWithinPartitions("slot", "sub", "fp")
            .mapInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, print, fp, root, component_id) per row of ``docs``; component_id is the smallest id reachable over links.

    Null and word-less texts have fingerprint 0 and link like any other. Rows
    with a null id get the component of their fingerprint; it is null only if
    no row there has an id. Repeated rows each get a row; an empty table gives none.
    """
    prints = stored(fingerprints(docs, key, text, shingle, seed), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    cc = components(links(distinct.select("fp"), radius))
    named = distinct.join(cc.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    table = stored(named.join(low, "root").select("fp", "root", "component_id"), "simhash-components")
    return prints.join(table, "fp").select("doc_id", "print", "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000, **params) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest id, then the smallest text hash.

    Only ids and hashes are shuffled to find the rows that go; they are
    broadcast up to ``broadcast_rows`` counted rows and joined beyond. Rows
    equal in id and text are told apart by nothing, so one of them stays.
    """
    rows = stored(near_duplicates(docs, key, text, **params).select("doc_id", "print", "root"), "simhash-rows")
    rows = rows.groupBy("root", "doc_id", "print").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "print")
    first = stored(rows.groupBy("root").agg(F.min(rank).alias("first")), "simhash-first")
    rows = rows.join(first, "root").withColumn("stays", rank == F.col("first"))
    rows = stored(rows.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "n", "stays"), "simhash-kept")
    gone, twice = rows.where("not stays").select("_id", "_print"), rows.where("stays and n > 1").select("_id", "_print")

    def same(side: DataFrame):
        return F.col(key).cast("long").eqNullSafe(side["_id"]) & (F.xxhash64(text_of(docs, text)) == side["_print"])

    kept = docs.join(small(gone, gone.count(), broadcast_rows), same(gone), "left_anti")
    n = twice.count()
    if n == 0:
        return kept
    twice = small(twice, n, broadcast_rows)
    single = (kept.join(twice, same(twice), "left_semi")
              .select(F.struct(*docs.columns).alias("record"), F.col(key).alias("id"), F.xxhash64(text_of(docs, text)).alias("print"))
              .dropDuplicates(["id", "print"]).select("record.*"))
    return kept.join(twice, same(twice), "left_anti").unionByName(single)


def op10_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
