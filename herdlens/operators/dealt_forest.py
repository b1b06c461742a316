"""Random forests whose rows are dealt to (tree, node): for training tables that MLlib's trees outgrow.

MLlib makes a pass over all rows for each group of nodes and holds every node on
the driver, so labels that the features don't decide make its work and its model
grow with the rows times the levels. Here a tree's nodes are split level by level by summed
histograms, as there, only while they hold more than ``GROUP_ROWS`` rows; below, a
node's rows meet in one group, which grows the rest of the tree from them. The
grown parts stay in Parquet. Rows of equal codes are scored once, by meeting the parts they
fall into; a part says which of its leaves a row ends in, and sends the counts of each such leaf once a chunk of rows.

Bins, bootstrap, features per node, impurity, depth and votes are MLlib's: at most
32 bins a numeric column, one 0/1 feature a category, Poisson(1) copies of each row, ceil(sqrt(features))
features drawn a node, Gini gain above 0, the mean of the leaves' class shares.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.sources.tables import ship, stored

BINS = 32
#: Nodes with at most so many (drawn) rows are grown on in one group.
GROUP_ROWS = 50_000
#: Rows that a task takes at a time.
CHUNK_ROWS = 20_000
#: Bytes of all votes on a chunk of scored rows, if every row has leaves of its own with all classes.
VOTE_BYTES = 100_000_000
#: (Tree, row) pairs that a task groups by (tree, node).
TASK_ROWS = 2_000_000
#: Bytes of scored codes up to which they are broadcast to the rows.
BROADCAST_BYTES = 8_000_000
#: Row groups of the dealt vectors, which are read a group at a time.
GROUP_BYTES = 4_000_000
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_PART = "tree int, node int, feat binary, thr binary, child binary, counts binary"


class Space:
    """The features of coded columns: a bin number a numeric column, a 0/1 feature a category."""

    def __init__(self, numeric: int, sizes: Sequence[int]):
        self.col = np.array([*range(numeric), *[numeric + i for i, n in enumerate(sizes) for _ in range(n)]])
        self.cat = np.array([-1] * numeric + [j for n in sizes for j in range(n)])
        self.width = numeric + len(sizes)
        self.drawn = math.ceil(math.sqrt(len(self.col)))
        self.dtype = np.dtype(np.uint8 if max([0, *sizes]) < 255 else np.int32)

    def bins(self, x: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Bin of feature ``f[i]`` in row i."""
        v, c = x[np.arange(len(x)), self.col[f]].astype(np.int64), self.cat[f]
        return np.where(c < 0, v, v == c)

    def draw(self, rng: np.random.Generator, nodes: int) -> np.ndarray:
        """Distinct features of each node."""
        out = np.sort(rng.integers(0, len(self.col), (nodes, self.drawn)), axis=1)
        while (again := np.flatnonzero((out[:, 1:] == out[:, :-1]).any(axis=1))).size:
            part = out[again]
            twice = np.zeros(part.shape, bool)
            twice[:, 1:] = part[:, 1:] == part[:, :-1]
            part[twice] = rng.integers(0, len(self.col), int(twice.sum()))
            out[again] = np.sort(part, axis=1)
        return out


def copies(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers by row and tree, the same in every pass."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1B54A32D192ED03 + seed * 0x2545F4914F6CDD1D + 1) % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")


def _cuts(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best (sum of squared class counts by side size, last bin on the left) of (node, bin, class) counts; -1 without a split."""
    left = hist.cumsum(axis=1)
    right = left[:, -1:] - left[:, :-1]
    left = left[:, :-1]
    nl, nr = left.sum(axis=2), right.sum(axis=2)
    score = (left * left).sum(axis=2) / np.maximum(nl, 1) + (right * right).sum(axis=2) / np.maximum(nr, 1)
    score[(nl == 0) | (nr == 0)] = -1
    at = score.argmax(axis=1)
    return score[np.arange(len(at)), at], at


def _no_gain(counts: np.ndarray) -> np.ndarray:
    """What a cut must exceed: the undivided node's value (and rounding)."""
    return (counts * counts).sum(axis=-1) / counts.sum(axis=-1) * (1 + 1e-11)


def _splits(space: Space, x, y, w, node, counts, classes: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(feature, last bin on the left) of each of the nodes that the rows lie in, sorted; feature -1: no gain."""
    k = len(counts)
    feat, thr, best = np.full(k, -1), np.zeros(k, np.int64), _no_gain(counts)
    sel = space.draw(rng, k)
    for s in range(space.drawn):
        f = sel[:, s]
        v = space.bins(x, f[node])
        for mask, bins in ((space.cat[f] >= 0, 2), (space.cat[f] < 0, BINS)):
            nodes = np.flatnonzero(mask)
            if not len(nodes):
                continue
            place = np.cumsum(mask) - 1
            take = slice(None) if len(nodes) == k else mask[node]
            key = (place[node[take]] * bins + v[take]) * classes + y[take]
            score, cut = _cuts(np.bincount(key, w[take], len(nodes) * bins * classes).reshape(-1, bins, classes))
            better = score > best[nodes]
            at = nodes[better]
            best[at], feat[at], thr[at] = score[better], f[at], cut[better]
    return feat, thr


def grow(space: Space, x, y, w, classes: int, depth: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A (part of a) tree of the rows: feature, last bin on the left, left child (the right one is next; -1: leaf), class counts."""
    out: list[tuple] = []
    node, k, base = np.zeros(len(y), np.int64), 1, 0
    while k:
        counts = np.bincount(node * classes + y, w, k * classes).reshape(k, classes)
        is_open = ((counts > 0).sum(axis=1) > 1) & (depth > 0)
        feat, thr = np.full(k, -1), np.zeros(k, np.int64)
        rows = is_open[node]
        x, y, w, node = x[rows], y[rows], w[rows], node[rows]
        opened = np.flatnonzero(is_open)
        place = (np.cumsum(is_open) - 1)[node]
        step = max(1, 2_000_000 // (BINS * classes))
        for a in range(0, len(opened), step):
            lo, hi = np.searchsorted(place, [a, a + step])
            at = opened[a:a + step]
            feat[at], thr[at] = _splits(space, x[lo:hi], y[lo:hi], w[lo:hi], place[lo:hi] - a, counts[at], classes, rng)
        inner = feat >= 0
        order = np.cumsum(inner) - 1
        out.append((feat, thr, np.where(inner, base + k + 2 * order, -1), counts))
        rows = inner[node]
        x, y, w, node = x[rows], y[rows], w[rows], node[rows]
        node = 2 * order[node] + (space.bins(x, feat[node]) > thr[node])
        rows = np.argsort(node, kind="stable")
        x, y, w, node = x[rows], y[rows], w[rows], node[rows]
        base, k, depth = base + k, 2 * int(inner.sum()), depth - 1
    return tuple(np.concatenate(v) for v in zip(*out))


def walk(space: Space, x, feat, thr, child) -> np.ndarray:
    """The leaf (or last node so far) of each row."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (rows := rows[child[at[rows]] >= 0]).size:
        here = at[rows]
        at[rows] = child[here] + (space.bins(x[rows], feat[here]) > thr[here])
    return at


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """``size`` rows at a time, less than twice as many at most."""
    held, n = [], 0
    for b in batches:
        for lo in range(0, len(b), size):
            held.append(b.iloc[lo:lo + size])
            n += len(held[-1])
            if n >= size:
                yield pd.concat(held)
                held, n = [], 0
    if n:
        yield pd.concat(held)


def _cells(codes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (codes, label) and which of them each row has: rows that no tree can tell apart are one weighted row."""
    both = np.ascontiguousarray(np.column_stack([codes.astype(np.int32), label.astype(np.int32)]))
    _, first, cell = np.unique(both.view(np.dtype((np.void, both.itemsize * both.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return codes[first], label[first], cell


def _by_node(at: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its rows) of the wanted nodes."""
    rows = np.flatnonzero(wanted[at])
    rows = rows[np.argsort(at[rows], kind="stable")]
    nodes, first = np.unique(at[rows], return_index=True)
    yield from zip(nodes.tolist(), np.split(rows, first[1:]))


class Tops:
    """The upper nodes of all trees, whose number follows rows / ``GROUP_ROWS``; counts of a node that is no leaf are empty."""

    def __init__(self, trees: list[dict[str, list]]):
        self.trees = trees

    @staticmethod
    def roots(trees: int, state: str) -> Tops:
        return Tops([{"feat": [-1], "thr": [0], "child": [-1], "depth": [0], "state": [state], "counts": [[]]} for _ in range(trees)])

    def arrays(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [tuple(np.array(t[c], np.int64) for c in ("feat", "thr", "child")) for t in self.trees]

    def are(self, state: str) -> list[np.ndarray]:
        return [np.array([s == state for s in t["state"]]) for t in self.trees]

    def number(self, state: str) -> int:
        return sum(int(a.sum()) for a in self.are(state))

    def split(self, tree: int, node: int, feat: int, thr: int, sides: list[list[float]], max_depth: int) -> None:
        t = self.trees[tree]
        if feat < 0:
            t["state"][node], t["counts"][node] = "leaf", [sum(c) for c in zip(*sides)]
            return
        t["feat"][node], t["thr"][node], t["child"][node], t["state"][node] = feat, thr, len(t["feat"]), "inner"
        depth = t["depth"][node] + 1
        for c in sides:
            ends = depth >= max_depth or sum(v > 0 for v in c) < 2
            state = "leaf" if ends else "dealt" if sum(c) <= GROUP_ROWS else "open"
            for key, v in (("feat", -1), ("thr", 0), ("child", -1), ("depth", depth), ("state", state), ("counts", list(c) if ends else [])):
                t[key].append(v)


def _split_level(coded: DataFrame, space: Space, tops: Tops, classes: int, max_depth: int, seed: int) -> None:
    """Splits every open node by one pass over the rows: histograms by task, summed by (tree, node)."""
    arrays, is_open, cells = tops.arrays(), tops.are("open"), space.drawn * BINS * classes
    names, size = coded.columns[2:], CHUNK_ROWS

    def drawn(tree: int, node: int) -> np.ndarray:
        return space.draw(np.random.default_rng([seed, tree, node, 0]), 1)[0]

    def sums(batches):
        for b in _chunks(batches, size):
            ids = b["id"].to_numpy()
            codes, label, same = _cells(b[names].to_numpy(space.dtype), b["y"].to_numpy())
            for t, wanted in enumerate(is_open):
                if not wanted.any():
                    continue
                w = np.bincount(same, copies(ids, t, seed), len(label))
                r = w > 0
                x, y, w = codes[r], label[r], w[r]
                at = walk(space, x, *arrays[t])
                rows = []
                for node, k in _by_node(at, wanted):
                    key = [(s * BINS + space.bins(x[k], np.full(len(k), f))) * classes + y[k] for s, f in enumerate(drawn(t, node))]
                    h = np.bincount(np.concatenate(key), np.tile(w[k], space.drawn), cells)
                    cell = np.flatnonzero(h)
                    rows.append((t, node, cell.astype(np.int32).tobytes(), h[cell].astype(np.int64).tobytes()))
                yield pd.DataFrame(rows, columns=["tree", "node", "cell", "n"])

    def best(key, g):
        t, node = map(int, key)
        h = np.zeros(cells)
        for c, n in zip(g["cell"], g["n"]):
            h[np.frombuffer(c, np.int32)] += np.frombuffer(n, np.int64)
        h = h.reshape(space.drawn, BINS, classes)
        score, cut = _cuts(h)
        s = int(score.argmax())
        feat = int(drawn(t, node)[s]) if score[s] > _no_gain(h[0].sum(axis=0)) else -1
        left = h[s, :cut[s] + 1].sum(axis=0)
        return pd.DataFrame({"tree": [t], "node": [node], "feat": [feat], "thr": [int(cut[s])], "l": [left.tolist()], "r": [(h[s].sum(axis=0) - left).tolist()]})

    found = (coded.mapInPandas(sums, "tree int, node int, cell binary, n binary").groupBy("tree", "node")
             .applyInPandas(best, "tree int, node int, feat int, thr int, l array<double>, r array<double>"))
    for r in sorted(found.collect(), key=lambda r: (r.tree, r.node)):  # as many rows as there are open nodes
        tops.split(r.tree, r.node, r.feat, r.thr, [r.l, r.r], max_depth)


def _tasks(spark: SparkSession, pairs: int) -> int:
    """For so many (tree, row) pairs; a task takes its groups one after another, and each may write a file."""
    return max(3 * spark.sparkContext.defaultParallelism, pairs // TASK_ROWS)


def _grown(coded: DataFrame, space: Space, tops: Tops, classes: int, max_depth: int, seed: int, n: int) -> DataFrame:
    """The parts of the trees below ``tops``: rows are dealt to (tree, node), each group grows its part."""
    arrays, dealt, depths = tops.arrays(), tops.are("dealt"), [t["depth"] for t in tops.trees]
    names, size, ytype = coded.columns[2:], CHUNK_ROWS, np.uint8 if classes < 256 else np.int32

    def deal(batches):
        for b in _chunks(batches, size):
            ids = b["id"].to_numpy()
            codes, label, same = _cells(b[names].to_numpy(space.dtype), b["y"].to_numpy())
            for t, wanted in enumerate(dealt):
                w = np.bincount(same, copies(ids, t, seed), len(label))
                r = np.flatnonzero(w)
                at = walk(space, codes[r], *arrays[t])
                yield pd.DataFrame([(t, node, codes[r[k]].tobytes(), label[r[k]].astype(ytype).tobytes(), w[r[k]].astype(np.int8 if w[r[k]].max() < 128 else np.int32).tobytes())
                                    for node, k in _by_node(at, wanted)], columns=["tree", "node", "x", "y", "w"])

    def part(key, g):
        t, node = map(int, key)
        x = np.frombuffer(b"".join(g["x"]), space.dtype).reshape(-1, space.width)
        y = np.frombuffer(b"".join(g["y"]), ytype).astype(np.int64)
        # Four bytes a weight where one is too large for a byte.
        w = np.concatenate([np.frombuffer(b, np.int8 if len(b) * np.dtype(ytype).itemsize == len(c) else np.int32) for b, c in zip(g["w"], g["y"])]).astype(float)
        feat, thr, child, counts = grow(space, x, y, w, classes, max_depth - depths[t][node], np.random.default_rng([seed, t, node, 1]))
        return pd.DataFrame([(t, node, *(v.astype(np.int32).tobytes() for v in (feat, thr, child)), counts[child < 0].astype(np.float32).tobytes())],
                            columns=["tree", "node", "feat", "thr", "child", "counts"])

    return (coded.mapInPandas(deal, "tree int, node int, x binary, y binary, w binary")
            .repartition(_tasks(coded.sparkSession, n * len(tops.trees)), "tree", "node").groupBy("tree", "node").applyInPandas(part, _PART))


def _thresholds(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """At most BINS - 1 cuts a column: between all values, if they are few, else quantiles."""
    out = []
    for c in columns:
        known = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        few = sorted(r.v for r in known.distinct().limit(BINS + 1).collect())
        if len(few) <= BINS:
            out.append([(a + b) / 2 for a, b in zip(few, few[1:])])
        else:
            out.append(sorted(set(known.approxQuantile("v", [i / BINS for i in range(1, BINS)], 0.001))))
    return out


def _above(v: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: v > t)) if cuts else F.lit(0)


class DealtForest:
    """A fitted forest: label and category vocabularies, cuts, upper nodes, and the other parts of its trees in Parquet."""

    def __init__(self, labels: list[str], numeric: list[str], thresholds: list[list[float]], indexer: StringIndexerModel | None,
                 tops: Tops, parts: DataFrame, rows: int):
        self.labels, self.numeric, self.thresholds, self.indexer, self.tops, self.parts, self.rows = labels, numeric, thresholds, indexer, tops, parts, rows
        self.space = Space(len(numeric), [len(v) for v in indexer.labelsArray] if indexer else [])

    @staticmethod
    def codes(df: DataFrame, numeric, thresholds, indexer) -> tuple[DataFrame, list[Column]]:
        """``df`` with indexed categories, and the code columns; missing numbers lie above all cuts, as NaN does in MLlib."""
        out = []
        for c, cuts in zip(numeric, thresholds):
            v = F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
            out.append(_above(v, cuts))
        if indexer:
            df = indexer.transform(df)
            out += [F.col(c).cast("int") for c in indexer.getOutputCols()]
        return df, [v.alias(f"x{i}") for i, v in enumerate(out)]

    @staticmethod
    def fit(train: DataFrame, label_idx: str, labels: list[str], numeric: Sequence[str], categorical: Sequence[str],
            num_trees: int, max_depth: int, seed: int, read: Callable[[], None] = lambda: None) -> DealtForest:
        """``read`` is called when ``train`` isn't needed any more."""
        spark = train.sparkSession
        ship(spark)
        indexer = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical], handleInvalid="keep",
                                stringOrderType="alphabetAsc").fit(train) if categorical else None
        thresholds = _thresholds(train, numeric)
        df, codes = DealtForest.codes(train, numeric, thresholds, indexer)
        coded = stored(df.select(F.monotonically_increasing_id().alias("id"), F.col(label_idx).cast("int").alias("y"), *codes), "forest-rows")
        read()
        n = coded.count()
        coded = coded.repartition(max(spark.sparkContext.defaultParallelism, n // GROUP_ROWS), "id")
        model = DealtForest(labels, list(numeric), thresholds, indexer, Tops.roots(num_trees, "open" if n > GROUP_ROWS else "dealt"), None, n)
        while model.tops.number("open"):
            _split_level(coded, model.space, model.tops, len(labels), max_depth, seed)
        model.parts = stored(_grown(coded, model.space, model.tops, len(labels), max_depth, seed, n), "forest-parts")
        return model

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep``, ``predicted_label`` and ``probability_array``: equal codes get equal votes, so each distinct code vector is scored."""
        df, codes = self.codes(df, self.numeric, self.thresholds, self.indexer)
        names = [f"x{i}" for i in range(self.space.width)]
        rows = stored(df.select(F.struct(*keep).alias("record"), *codes), "forest-scored")
        cells = stored(rows.select(*names).distinct().withColumn("id", F.monotonically_increasing_id()), "forest-cells")
        n = cells.count()
        scored = cells.join(self._scored(cells, n, names), "id").drop("id")
        if n * (8 * len(self.labels) + 8 * len(names)) <= BROADCAST_BYTES:
            scored = F.broadcast(scored)
        labels = F.array(*[F.lit(v) for v in self.labels])
        return rows.join(scored, names).select("record.*", F.element_at(labels, F.col("at") + 1).alias("predicted_label"), "probability_array")

    def _scored(self, cells: DataFrame, n: int, names: list[str]) -> DataFrame:
        """Best class and shares by id: code vectors meet the parts they fall into, votes are summed up by chunk of vectors."""
        spark, space, classes, trees = cells.sparkSession, self.space, len(self.labels), len(self.tops.trees)
        size = max(1, min(CHUNK_ROWS, VOTE_BYTES // (trees * (8 + 12 * classes))))
        arrays, dealt, leaves = self.tops.arrays(), self.tops.are("dealt"), self.tops.are("leaf")
        leaf_counts = [t["counts"] for t in self.tops.trees]

        def voted(leaf, counts):
            """Which of the leaves sent is each row's; non-zero places and values of (leaf, class) counts."""
            used, leaf = np.unique(leaf, return_inverse=True)
            counts = counts[used].astype(float).ravel()
            cell = np.flatnonzero(counts)
            return leaf.astype(np.int32).tobytes(), cell.astype(np.int32).tobytes(), counts[cell].tobytes()

        def deal(batches):
            for b in _chunks(batches, size):
                ids, codes = b["id"].to_numpy(), b[names].to_numpy(space.dtype)
                chunk = int(ids[0])
                out = [(chunk, -1, -1, ids.tobytes(), None, None, None, None)]
                for t, (wanted, ends) in enumerate(zip(dealt, leaves)):
                    at = walk(space, codes, *arrays[t])
                    out += [(chunk, t, node, k.astype(np.int32).tobytes(), codes[k].tobytes(), None, None, None) for node, k in _by_node(at, wanted)]
                    for node, k in _by_node(at, ends):
                        out.append((chunk, t, node, k.astype(np.int32).tobytes(), None, *voted(np.zeros(len(k), np.int64), np.array([leaf_counts[t][node]], float))))
                    yield pd.DataFrame(out, columns=["chunk", "tree", "node", "rows", "x", "leaf", "cell", "n"])
                    out = []

        def vote(key, g, part):
            out = []
            if len(g) and len(part):
                feat, thr, child = (np.frombuffer(part[c].iloc[0], np.int32).astype(np.int64) for c in ("feat", "thr", "child"))
                counts = np.frombuffer(part["counts"].iloc[0], np.float32).reshape(-1, classes)
                leaf = np.cumsum(child < 0) - 1
                x = np.frombuffer(b"".join(g["x"]), space.dtype).reshape(-1, space.width)
                at = leaf[walk(space, x, feat, thr, child)]
                lo = 0
                for chunk, r in zip(g["chunk"], g["rows"]):
                    out.append((chunk, int(key[0]), r, *voted(at[lo:lo + len(r) // 4], counts)))
                    lo += len(r) // 4
            return pd.DataFrame(out, columns=["chunk", "tree", "rows", "leaf", "cell", "n"])

        def total(key, g):
            g = g.sort_values("tree")  # the ids first; and so that sums don't depend on the order of arrival
            ids = np.frombuffer(g["rows"].iloc[0], np.int64)
            p = np.zeros((len(ids), classes))
            for message in zip(*(g[c].iloc[1:] for c in ("rows", "leaf", "cell", "n"))):
                rows, leaf, cell, counts = (np.frombuffer(m, d) for m, d in zip(message, (np.int32, np.int32, np.int32, np.float64)))
                shares = np.bincount(cell, counts, (int(leaf.max()) + 1) * classes).reshape(-1, classes)
                shares /= shares.sum(axis=1, keepdims=True)
                p[rows] += shares[leaf]
            p /= p.sum(axis=1, keepdims=True)
            return pd.DataFrame({"id": ids, "at": p.argmax(axis=1).astype(np.int32), "probability_array": list(p)})

        parallel = spark.sparkContext.defaultParallelism
        # Stored, as rows are numbered within their chunk: a second run of a task may meet them in another order.
        sent = stored(cells.repartition(max(parallel, n // (4 * size)), "id").select("id", *names).mapInPandas(
            deal, "chunk long, tree int, node int, rows binary, x binary, leaf binary, cell binary, n binary"), "forest-dealt", GROUP_BYTES)
        # As many rows as there are parts; where many vectors fall into a part, it meets them in several groups.
        salts = F.broadcast(sent.where("x IS NOT NULL").groupBy("tree", "node").agg(
            F.ceil(F.sum(F.length("rows")) / (4 * GROUP_ROWS)).cast("int").alias("salts")))
        keys, tasks = ["tree", "node", "salt"], _tasks(spark, n * trees)
        asked = sent.where("x IS NOT NULL").join(salts, ["tree", "node"]).select(
            "chunk", "tree", "node", "rows", "x", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int").alias("salt"))
        parts = self.parts.join(salts, ["tree", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        votes = (asked.repartition(tasks, *keys).groupBy(*keys).cogroup(parts.repartition(tasks, *keys).groupBy(*keys))
                 .applyInPandas(vote, "chunk long, tree int, rows binary, leaf binary, cell binary, n binary"))
        votes = votes.unionByName(sent.where("x IS NULL").select(*votes.columns))
        chunks = max(3 * parallel, n // (4 * size))
        return votes.repartition(chunks, "chunk").groupBy("chunk").applyInPandas(total, "id long, at int, probability_array array<double>")

    def class_probability_pct(self, cls: str, prob_col: str = "probability_array") -> Column:
        """P(cls) x 100, rounded half-even to 2; class absent -> index 0."""
        idx = self.labels.index(cls) if cls in self.labels else 0
        return F.bround(F.element_at(F.col(prob_col), idx + 1) * 100.0, 2)

    def save(self, spark: SparkSession, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        if self.indexer:
            self.indexer.write().overwrite().save(f"{path}/indexer")
        meta = json.dumps({"labels": self.labels, "numeric": self.numeric, "thresholds": self.thresholds, "tops": self.tops.trees,
                           "rows": self.rows, "indexed": self.indexer is not None})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dealt")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DealtForest:
        ship(spark)
        m = json.loads(spark.read.parquet(f"{path}/dealt").first().meta)
        indexer = StringIndexerModel.load(f"{path}/indexer") if m["indexed"] else None
        return DealtForest(m["labels"], m["numeric"], m["thresholds"], indexer, Tops(m["tops"]), spark.read.schema(_PART).parquet(f"{path}/parts"), m["rows"])
