"""N-gram Jaccard join by signature trees.

A document's set holds its distinct 5-word shingles (hashed to 64 bits); two
documents link when their sets' Jaccard similarity reaches ``percent``. Equal
sets are merged first, so copies cost nothing further.

1. *Keys.* Under one total order of shingles two linked sets share one of their
   first ``n - ceil(percent * n) + 1`` shingles. The order puts shingles of busy
   hash buckets last (counted over all documents; only the order depends on the
   counts, never the result), so common passages are rarely keys. Sets that share
   a key form a cell; cells with the same members count once.
2. *Candidates.* Each cell is a signature tree: a leaf is a set's bitmap and
   size, a node the OR of its children's bitmaps and the range of their sizes.
   A dual traversal drops node pairs whose sizes can't match or whose maximum
   possible overlap is too small. It returns a spanning forest, never all pairs.
   A cell over ``cell_rows`` sets is dealt to tasks as pairs of blocks.
3. *Links.* The connected candidates of a group meet in one task with their
   whole sets; the same traversal confirms each pair by the exact overlap and
   skips what is connected already. A group of over ``group_tokens`` shingles
   doesn't meet: its cells do, in blocks of that size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import small, stored, text_of
from herdlens.llm.components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Hash buckets whose counts order the shingles; 2**BUCKET_BITS bytes are broadcast whatever the corpus.
BUCKET_BITS = 20


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of UTF-8 text; all words as one if fewer."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64))


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of ``a`` and ``b`` elements with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def key_shingles(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    order = np.lexsort((tokens, levels[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
    return tokens[order[:n - -(-percent * n // 100) + 1]]


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` shingles: the power of two from 2n on, 128 at least."""
    return 1 << max(7, (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> int:
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def folded(bits: int, width: int, to: int) -> int:
    """A bitmap of ``width`` bits as one of ``to`` bits."""
    while width > to:
        width >>= 1
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Forest:
    """Which rows are connected so far; roots are the smallest rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class SignatureTree:
    """Sets as (size, bitmap) leaves in the given order; ``levels[k][x]`` is (bits, least size, greatest size,
    most shingles hidden by bit collisions, first leaf, end leaf) of node x."""

    def __init__(self, sizes: list[int], bits: list[int], fanout: int = 4):
        self.fanout = fanout
        level = [(b, n, n, n - b.bit_count(), i, i + 1) for i, (n, b) in enumerate(zip(sizes, bits))]
        self.levels = [level]
        while len(level) > 1:
            above = []
            for i in range(0, len(level), fanout):
                part = level[i:i + fanout]
                bits_ = 0
                for p in part:
                    bits_ |= p[0]
                above.append((bits_, min(p[1] for p in part), max(p[2] for p in part), max(p[3] for p in part), part[0][4], part[-1][5]))
            self.levels.append(level := above)


def apart(x: tuple, y: tuple, percent: int) -> bool:
    """No set below node ``x`` can link with one below ``y``."""
    if 100 * x[2] < percent * y[1] or 100 * y[2] < percent * x[1]:
        return True
    # Common shingles share a bit; at most the hidden ones of either side come on top.
    return (x[0] & y[0]).bit_count() + min(x[3], y[3]) < least_overlap(x[1], y[1], percent)


def dual_traversal(tree: SignatureTree, rows: list[int], percent: int, forest: Forest, confirm: Callable[[int, int], bool],
                   side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of ``rows`` (the leaves) that can link, are confirmed and connect what wasn't connected.

    ``side``: each row's side of a pair of blocks; pairs of the same side are left out.
    """
    levels, fanout = tree.levels, tree.fanout
    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        k, x, y = todo.pop()
        a, b = levels[k][x], levels[k][y]
        if x != y and apart(a, b, percent):
            continue
        if k == 0:
            i, j = rows[x], rows[y]
            if i != j and (side is None or side[i] != side[j]) and forest.root(i) != forest.root(j) and confirm(i, j):
                forest.unite(i, j)
                yield i, j
            continue
        if k > 1 and a[5] - a[4] + b[5] - b[4] <= 64:
            root = forest.root(rows[a[4]])
            if all(forest.root(rows[i]) == root for r in (a, b) for i in range(r[4], r[5])):
                continue
        below = len(levels[k - 1])
        ys = range(y * fanout, min(y * fanout + fanout, below))
        for i in range(x * fanout, min(x * fanout + fanout, below)):
            todo.extend((k - 1, i, j) for j in ys if x != y or i <= j)


def _bands(sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows by ranges of size so that two rows whose sizes match are in one of them; greatest and least size differ
    by a factor of (100 / percent)**2 at most, so that bitmaps of one width suit all."""
    band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)
    seen = np.unique(band)
    out = [np.flatnonzero((band == k) | (band == k + 1)) for k in seen.tolist()]
    return [r for r, k in zip(out, seen.tolist()) if len(r) > 1 and (k - 1 not in seen or (band[r] == k + 1).any())]


def _edges(sizes: np.ndarray, bitmaps: Callable[[list[int]], dict[int, int]], percent: int, confirm: Callable[[int, int], bool],
           side: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest (rows) of the confirmed pairs, by one signature tree a range of sizes."""
    out, forest = [], Forest(len(sizes))
    for band in _bands(sizes, percent):
        rows = band.tolist()
        bits = bitmaps(rows)
        rows.sort(key=bits.__getitem__)  # like bitmaps side by side
        tree = SignatureTree([int(sizes[i]) for i in rows], [bits[i] for i in rows])
        out.extend(dual_traversal(tree, rows, percent, forest, confirm, side))
    return out


def candidate_edges(sizes: np.ndarray, signatures: list[bytes], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest (rows) of the pairs of a cell that their bitmaps can't tell apart."""

    def bitmaps(rows: list[int]) -> dict[int, int]:
        width = min(width_of(int(sizes[i])) for i in rows)
        return {i: folded(int.from_bytes(signatures[i], "little"), 8 * len(signatures[i]), width) for i in rows}

    return _edges(sizes, bitmaps, percent, lambda i, j: True, side)


def exact_edges(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest (rows) of the linked pairs of ``sets``."""
    sizes = np.array([len(s) for s in sets])

    def bitmaps(rows: list[int]) -> dict[int, int]:
        width = 4 * width_of(int(sizes[rows].max()))
        return {i: bitmap(sets[i], width) for i in rows}

    def linked(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int((b[at] == a).sum()) >= least_overlap(len(a), len(b), percent)

    return _edges(sizes, bitmaps, percent, linked, side)


# ---------------------------------------------------------------- on Spark


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = text_of(docs, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("print"), F.encode(t, "utf-8").alias("text"))


def _set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def set_sizes(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, n, hash) per row, stored, and a row (busy) per task: its busy buckets and their counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            sizes, hashes, held, size = [], [], [], 0
            for t in b.column(2).to_pylist():
                s = shingle_set(t, shingle)
                sizes.append(len(s))
                hashes.append(_set_id(s))
                held.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, total, size = [], total + size, 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                total += size
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.nulls(len(sizes), pa.binary()),
                                              pa.nulls(len(sizes), pa.int64())], names=["doc_id", "n", "hash", "busy", "total"])
        busy = np.flatnonzero(counts > max(1, 2 * total / len(counts)))
        table = np.stack([busy, counts[busy]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([table], pa.binary()),
                                          pa.array([total])], names=["doc_id", "n", "hash", "busy", "total"])

    return stored(_scan(docs, key, text).mapInArrow(scan, "doc_id long, n long, hash binary, busy binary, total long"), "ngram-sizes")


def bucket_levels(sizes: DataFrame) -> np.ndarray:
    """A byte per hash bucket: by how many powers of two its count is above the mean."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                bucket, count = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(count)], names=["bucket", "count"])

    tasks = sizes.where("busy is not null")
    mean = max(1.0, (tasks.agg(F.sum("total")).first()[0] or 0) / (1 << BUCKET_BITS))
    # At most one row a bucket reaches the driver.
    busy = (tasks.select("busy").mapInArrow(spread, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
            .where(F.col("count") >= 2 * mean).select("bucket", F.floor(F.log2(F.col("count") / mean)).cast("int").alias("level")).toArrow())
    levels = np.zeros(1 << BUCKET_BITS, np.int8)
    levels[busy["bucket"].to_numpy()] = np.minimum(busy["level"].to_numpy(), 100)
    return levels


def distinct_sets(docs: DataFrame, levels: np.ndarray, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """One stored row per distinct non-empty set: (sid, hash, n, print, rep, keys, signature)."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for b in batches:
            rows = {"rep": [], "print": [], "n": [], "hash": [], "keys": [], "signature": []}
            for rep, print_, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = shingle_set(t, shingle)
                if not len(s):
                    continue
                width = width_of(len(s))
                for name, value in zip(rows, (rep, print_, len(s), _set_id(s), key_shingles(s, order, percent).view(np.int64),
                                              bitmap(s, width).to_bytes(width // 8, "little"))):
                    rows[name].append(value)
            kinds = {"rep": pa.int64(), "print": pa.int64(), "n": pa.int64(), "hash": pa.binary(), "keys": pa.list_(pa.int64()), "signature": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in kinds], names=list(kinds))

    rows = _scan(docs, key, text).mapInArrow(scan, "rep long, print long, n long, hash binary, keys array<long>, signature binary")
    one = rows.dropDuplicates(["hash"]).withColumn("sid", F.monotonically_increasing_id())
    return stored(one, "ngram-sets")


def cells(sets: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """(cell, members, sid, n): the distinct groups of two or more sets that share a key, stored."""
    keys = sets.select("sid", "n", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "ngram-shared")
    rows = stored(keys.join(small(shared, shared.count(), broadcast_rows), "key"), "ngram-members")
    # Cells with the same members are told by their number and two XORs of hashed members.
    alike = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("sid")).alias("x"),
                                     F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"), F.min("n").alias("low"), F.max("n").alias("high"))
             # Two sets whose sizes can't match are no cell.
             .where(f"members > 2 or 100 * low >= {percent} * high")
             .groupBy("members", "x", "y", "low", "high").agg(F.min("key").alias("key")))
    alike = stored(alike.select("key", "members"), "ngram-cells")
    return stored(rows.join(small(alike, alike.count(), broadcast_rows), "key").select(F.col("key").alias("cell"), "members", "sid", "n"), "ngram-units")


def block_pairs(units: DataFrame, weight: str, limit: int) -> DataFrame:
    """``units`` (cell, sid, .., ``weight`` of its cell) dealt to tasks: columns (first, second, side) tell the pair of blocks.

    A cell within ``limit`` is one block; else its sets are dealt to blocks by a hash and go to every pair of their block.
    """
    g = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    own = F.expr(f"cast(pmod(xxhash64(sid, 7), ceil({weight} / {limit})) as int)")
    pairs = F.when(g <= 1, F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), g - 1), lambda o: F.struct(F.least(own, o).alias("first"), F.greatest(own, o).alias("second"),
                                                                    (own > o).cast("int").alias("side"))))
    return units.withColumn("_at", F.explode(pairs)).select(*units.columns, "_at.first", "_at.second", "_at.side")


def _by_unit(dealt: DataFrame, edges: Callable[[list, np.ndarray, np.ndarray | None], list[tuple[int, int]]]) -> DataFrame:
    """Edges (u, v) of each unit (cell, first, second) of ``dealt`` (cell, first, second, side, sid, load)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def done() -> pa.RecordBatch:
            sids, loads, sides = zip(*rows)
            found = edges(list(loads), None if unit[1] == unit[2] else np.array(sides)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([sids[i] for i, _ in found], pa.int64()), pa.array([sids[j] for _, j in found], pa.int64())],
                                              names=["u", "v"])

        for b in batches:
            for cell, first, second, side, sid, load in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (cell, first, second) != unit:
                    if rows:
                        yield done()
                    unit, rows = (cell, first, second), []
                rows.append((sid, load, side))
        if rows:
            yield done()

    at = ["cell", "first", "second"]
    return (dealt.select(*at, "side", "sid", "load").repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "u long, v long"))


def candidates(units: DataFrame, sets: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """Stored forest edges (u, v) of the pairs that the cells' signature trees leave."""

    def edges(loads: list[dict], side: np.ndarray | None) -> list[tuple[int, int]]:
        return candidate_edges(np.array([x["n"] for x in loads]), [x["signature"] for x in loads], percent, side)

    rows = block_pairs(units, "members", cell_rows).join(sets.select("sid", "signature"), "sid").withColumn("load", F.struct("n", "signature"))
    return stored(_by_unit(rows, edges).distinct(), "ngram-candidates")


def links(docs: DataFrame, groups: DataFrame, units: DataFrame, sets: DataFrame, key: str, text: str, shingle: int, percent: int,
          group_tokens: int, broadcast_rows: int) -> DataFrame:
    """Stored edges (u, v) that connect exactly the linked sets. ``groups``: (sid, root) of connected candidates."""
    named = stored(groups.join(sets.select("sid", "rep", "print", "n"), "sid"), "ngram-groups")
    wanted = small(named.select("sid", F.col("rep").alias("_rep"), F.col("print").alias("_print")), named.count(), broadcast_rows)
    rows = _scan(docs, key, text)
    rows = rows.join(wanted, (rows["print"] == F.col("_print")) & rows["doc_id"].eqNullSafe(F.col("_rep"))).select("sid", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), tokens], names=["sid", "tokens"])

    whole = stored(rows.mapInArrow(scan, "sid long, tokens binary").dropDuplicates(["sid"]), "ngram-whole")
    size = stored(named.groupBy("root").agg(F.sum("n").alias("weight")), "ngram-weights")
    sized = named.join(size, "root").select("sid", "n", "root", "weight")
    few = sized.where(F.col("weight") <= group_tokens).select(F.col("root").alias("cell"), "sid", F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side"))
    # Beyond, sets meet in the cells they share, dealt in blocks.
    many = units.select("cell", "sid").join(sized.where(F.col("weight") > group_tokens).select("sid", "n"), "sid")
    heavy = many.groupBy("cell").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("c")).where("c > 1").select("cell", "weight")
    many = block_pairs(many.join(heavy, "cell").select("cell", "sid", "weight"), "weight", group_tokens).drop("weight")
    dealt = few.unionByName(many).join(whole.withColumnRenamed("tokens", "load"), "sid")

    def edges(loads: list[bytes], side: np.ndarray | None) -> list[tuple[int, int]]:
        return exact_edges([np.frombuffer(x, np.uint64) for x in loads], percent, side)

    return stored(_by_unit(dealt, edges).distinct(), "ngram-links")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, cell_rows: int = 4096,
                       group_tokens: int = 2_000_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    component_id is the smallest id reachable over links. Null, empty and
    word-less texts have an empty set and link with nothing: their component is
    their own id. A row with a null id gets the component of its set, null only
    if no row there has an id. Repeated rows each get a row; rows of one id
    with different texts link only by their texts. An empty table gives none.
    ``cell_rows``, ``group_tokens`` and ``broadcast_rows`` only choose how the
    work is dealt.
    """
    sizes = set_sizes(docs, key, text, shingle)
    sets = distinct_sets(docs, bucket_levels(sizes), key, text, shingle, percent)
    units = cells(sets, percent, broadcast_rows)
    found = components(candidates(units, sets, percent, cell_rows))
    groups = found.select(F.col("node").alias("sid"), "root").unionByName(found.select(F.col("root").alias("sid"), "root").distinct())
    linked = components(links(docs, groups, units, sets, key, text, shingle, percent, group_tokens, broadcast_rows))
    rows = sizes.where("hash is not null")
    low = rows.where("n > 0").groupBy("hash").agg(F.min("doc_id").alias("low"))
    named = (low.join(sets.select("hash", "sid"), "hash").join(linked.select(F.col("node").alias("sid"), "root"), "sid", "left")
             .withColumn("root", F.coalesce("root", "sid")))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    table = stored(named.join(least, "root").select("hash", "component_id"), "ngram-components")
    own = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(table, "hash").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(own)


def op11_query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hit AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM hit JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id FROM documents d
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) c ON c.u = d.doc_id
"""
