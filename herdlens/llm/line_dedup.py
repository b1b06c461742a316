"""Line dedup by a sharded minimal perfect hash that documents probe.

1. Every line's key (ASCII-trimmed, ASCII-lower-cased) is hashed to 128 bits;
   counts of documents and the largest doc_id per hash are summed, partially
   before the shuffle.
2. The hashes that can cause a drop are dealt into shards. Each shard builds a
   minimal perfect hash over its keys (levels of collision-free bits, rank by
   bit count) indexing compact arrays: 64-bit fingerprint, count, last doc_id.
3. Documents probe the arrays as they are scanned: no line is shuffled or
   joined. The arrays are broadcast only within ``broadcast_bytes``; a larger
   index is probed in groups of shards of that size, each group marking lines,
   and the marks meet the documents in one join.

128 bits identify a key: 64 choose shard and slot, the other 64 are the
fingerprint that turns away keys that are not in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored, text_of

BLANKS = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)  # a null id is below every id
_RUN_BYTES = 2 << 20
_MAX_SEEN = 50_000


def keys_of(text: bytes, min_chars: int) -> tuple[int, list[int], list[bytes]]:
    """(number of lines, numbers of the lines long enough, their 16-byte key hashes)."""
    at, digests = [], []
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        key = line.strip(BLANKS)
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            continue
        at.append(i)
        digests.append(xxhash.xxh3_128_digest(key.lower()))
    return len(lines), at, digests


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Every batch's rows in runs of ``_RUN_BYTES`` of text (a longer text is a run of its own).

    An Arrow batch holds up to 64 MB; its texts become Python objects a run at a time.
    """
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + _RUN_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _level_slot(slot_hash: np.ndarray, print_hash: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_mix(slot_hash + _mix(print_hash + np.uint64(level))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over 128-bit keys given as two uint64 arrays.

    Level k has two bits of room for each key left; a key alone at its place
    sets the bit, the others go on to level k + 1. A key's index is the number
    of set bits before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, slot_hash: np.ndarray, print_hash: np.ndarray) -> PerfectHash:
        sizes, marks, level = [], [], 0
        a, b = slot_hash, print_hash
        while len(a):
            bits = -(-2 * len(a) // 64) * 64
            place = _level_slot(a, b, level, bits)
            taken = np.bincount(place, minlength=bits)
            alone = taken == 1
            sizes.append(bits)
            marks.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = taken[place] > 1
            a, b, level = a[left], b[left], level + 1
        return cls(sizes, np.concatenate(marks) if marks else np.zeros(0, np.uint64))

    def index(self, slot_hash: np.ndarray, print_hash: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has its bit (surely not a member)."""
        out = np.full(len(slot_hash), -1, np.int64)
        left = np.arange(len(slot_hash))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            place = self.starts[level] + _level_slot(slot_hash[left], print_hash[left], level, bits)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[place >> 6] + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out


def _scan(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, n, last) of batches (key, text); a key hash comes again after a flush."""
    seen: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        h = np.frombuffer(b"".join(seen), dtype=np.int64).reshape(-1, 2)
        n, last = zip(*seen.values()) if seen else ((), ())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64()), pa.array(last, pa.int64())],
                                          names=["h1", "h2", "n", "last"])

    for batch in _runs(batches, "text"):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, t in zip(ids, texts):
            i = _NO_ID if i is None else i
            for d in set(keys_of(t, min_chars)[2]):
                e = seen.get(d)
                if e is None:
                    seen[d] = [1, i]
                else:
                    e[0] += 1
                    if i > e[1]:
                        e[1] = i
            if len(seen) > _MAX_SEEN:
                yield flush()
    yield flush()


def line_counts(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, n, last): documents holding each line key and the largest id among them."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(docs, text).cast("binary").alias("text"))
    return (rows.mapInArrow(lambda batches: _scan(batches, min_chars), "h1 long, h2 long, n long, last long")
            .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")))


def build_index(frequent: DataFrame, n_keys: int, keys_per_shard: int) -> tuple[DataFrame, int]:
    """One row per shard: the perfect hash and its fingerprint, count and last-id arrays."""
    shards = max(1, -(-n_keys // keys_per_shard))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g["h1"].to_numpy().view(np.uint64), g["h2"].to_numpy().view(np.uint64)
        h = PerfectHash.build(a, b)
        order = np.empty(len(g), np.int64)
        order[h.index(a, b)] = np.arange(len(g))
        return pd.DataFrame([{
            "shard": int(g["shard"].iloc[0]), "sizes": h.sizes, "words": h.words.tobytes(),
            "prints": b[order].tobytes(), "counts": g["n"].to_numpy()[order].tobytes(),
            "lasts": g["last"].to_numpy()[order].tobytes()}])

    t = frequent.withColumn("shard", F.expr(f"pmod(shiftright(h1, 3), {shards})"))
    return t.groupBy("shard").applyInPandas(
        build, "shard long, sizes array<long>, words binary, prints binary, counts binary, lasts binary"), shards


class LineIndex:
    """Probe side: some of the shards' arrays."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.at = {r["shard"]: (PerfectHash(list(r["sizes"]), np.frombuffer(r["words"], np.uint64)),
                                np.frombuffer(r["prints"], np.uint64), np.frombuffer(r["counts"], np.int64),
                                np.frombuffer(r["lasts"], np.int64)) for r in rows}

    def dropped(self, h: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines go; ``h`` (n, 2) int64 key hashes, ``ids`` their documents."""
        out = np.zeros(len(h), bool)
        if not len(h):
            return out
        a, b = h[:, 0].copy().view(np.uint64), h[:, 1].copy().view(np.uint64)
        shard = (h[:, 0] >> 3) % self.shards
        for s, (perfect, prints, counts, lasts) in self.at.items():
            mine = np.flatnonzero(shard == s) if self.shards > 1 else np.arange(len(h))
            at = perfect.index(a[mine], b[mine])
            mine, at = mine[at >= 0], at[at >= 0]
            known = (prints[at] == b[mine]) & (counts[at] >= min_docs)
            out[mine] = known & (ids[mine] != lasts[at])
        return out


def _probe(batch_ids: list, texts: list[bytes], index: LineIndex, min_chars: int, min_docs: int):
    """(number of lines, dropped line numbers) of each text."""
    totals, ats, digests, owners = [], [], [], []
    for t, i in zip(texts, batch_ids):
        n, at, d = keys_of(t, min_chars)
        totals.append(n)
        ats.append(at)
        digests += d
        owners.append(_NO_ID if i is None else i)
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    gone = index.dropped(h, np.repeat(np.array(owners, np.int64), [len(x) for x in ats]), min_docs)
    start = 0
    for n, at in zip(totals, ats):
        g = gone[start:start + len(at)]
        start += len(at)
        yield n, [x for x, y in zip(at, g) if y] if g.any() else []


def _clean(batches: Iterator[pa.RecordBatch], text: str, index: LineIndex, min_chars: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """The batches with the lines that stay and both numbers, without ``_key``."""
    for batch in _runs(batches, text):
        names = batch.schema.names
        texts = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
        kept, totals, drops = [], [], []
        for t, (n, gone) in zip(texts, _probe(batch.column(names.index("_key")).to_pylist(), texts, index, min_chars, min_docs)):
            totals.append(n)
            drops.append(len(gone))
            if gone:
                away = set(gone)
                t = b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in away])
            kept.append(t)
        new = {text: pa.array(kept, pa.binary()).cast(pa.string()), "_n_lines": pa.array(totals, pa.int64()), "_n_dropped": pa.array(drops, pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names) if c != "_key"],
                                         names=[c for c in names if c != "_key"])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                keys_per_shard: int = 65_536, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the repeated lines, plus long ``_n_lines`` (before) and ``_n_dropped``.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents goes from every document but the largest id
    holding it. Each row counts as a document (repeated rows too, and all rows
    of the largest id keep the line); a null id is below all others; null text
    is one empty line. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    frequent = stored(line_counts(docs, key, text, min_chars).where(F.col("n") >= min_docs), "lines-frequent")
    table, shards = build_index(frequent, frequent.count(), keys_per_shard)
    table = stored(table, "lines-index")
    size = F.length("words") + F.length("prints") + F.length("counts") + F.length("lasts")
    total = table.agg(F.sum(size.cast("long"))).first()[0] or 0
    groups = max(1, -(-total // broadcast_bytes))

    def index_of(g: int):
        # Bounded by broadcast_bytes (shards hold near-equal numbers of keys).
        rows = table.where(F.col("shard") % groups == g).collect()
        return spark.sparkContext.broadcast([r.asDict() for r in rows])

    inner = docs.withColumns({"_n_lines": F.lit(0).cast("long"), "_n_dropped": F.lit(0).cast("long"), text: text_of(docs, text)})
    if groups == 1:
        held = index_of(0)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _clean(batches, text, LineIndex(held.value, shards), min_chars, min_docs)

        return inner.withColumn("_key", F.col(key).cast("long")).mapInArrow(clean, inner.schema)

    def marking(held):
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = LineIndex(held.value, shards)
            for batch in _runs(batches, "_text"):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                out = [(i, p, gone) for i, p, (_, gone) in zip(ids, batch.column(2).to_pylist(), _probe(ids, texts, index, min_chars, min_docs)) if gone]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in
                                                  enumerate((pa.int64(), pa.string(), pa.list_(pa.int32())))], names=["_id", "_print", "_gone"])

        return mark

    marks = None
    for g in range(groups):
        rows = docs.select(F.col(key).cast("long").alias("_id"), text_of(docs, text).alias("_text"), F.sha2(text_of(docs, text), 256).alias("_print"))
        part = stored(rows.mapInArrow(marking(index_of(g)), "_id long, _print string, _gone array<int>"), "lines-marks")
        marks = part if marks is None else marks.unionByName(part)
    # Decisions hang on id and text alone, so repeated rows share one mark.
    marks = stored(marks.distinct().groupBy("_id", "_print").agg(F.array_distinct(F.flatten(F.collect_list("_gone"))).alias("_gone")), "lines-marks")
    lines = F.split(F.col(text), "\n", -1)
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    return (inner.withColumn("_sha", F.sha2(F.col(text), 256))
            .join(marks, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_print")), "left")
            .withColumn("_n_lines", F.size(lines).cast("long")).withColumn("_n_dropped", F.size(gone).cast("long"))
            .withColumn(text, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
            .select(*inner.columns))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with the lines that stay as their text; the other columns, of any name, are as they were."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("record"))
    out = dedup_lines(rows, **params)
    return out.select(*[(F.col("text") if c == text else F.col("record").getField(c)).alias(c) for c in docs.columns])


def op8_query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
freq AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
         GROUP BY key HAVING count(DISTINCT rid) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN freq f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
