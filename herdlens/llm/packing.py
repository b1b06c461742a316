"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so a solution over any number of
documents is a list of bin patterns (the lengths in a bin) with counts, over a
histogram of at most ``capacity`` lengths. Only that histogram and solutions of
bounded size travel; documents stay distributed and take their places by rank.

* Crossover injects whole well-filled bins of one parent into the other, whose
  bins that would use a document twice are removed; the displaced documents
  are best-fitted into the gaps left and then into new bins.
* Mutation empties the worst bins and some others and best-fits their content.
* Islands evolve in parallel tasks; after each epoch the elites migrate to the
  next island through a shuffle.
"""

from __future__ import annotations

import bisect
import json
import zlib
from base64 import b64decode
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import ranked, stored, text_of

CAPACITY = 1024
END_ID = 2


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str, pattern: str):
    """ids of a text as the tokenizers file ``vocabulary`` gives them.

    The rank file holds the same vocabulary for a faster encoder; texts that
    hold an added token of the vocabulary go to the vocabulary's own encoder.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    with open(ranks, "rb") as f:
        table = {b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    exact = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(vocabulary))

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return exact().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, cut only where longer than ``capacity``.

    The first piece takes the remainder, so all others are full. Null text is
    empty and has the end id alone; repeated rows give repeated pieces.
    """
    files = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*files)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(t), end_id], "<u4")
                raw, at, n = memoryview(ids.tobytes()), 0, 0
                upto = (len(ids) - 1) % capacity + 1
                while at < len(ids):
                    for col, v in zip(rows, (i, n, at, upto - at, zlib.crc32(raw[4 * at:4 * upto]))):
                        col.append(v)
                    at, upto, n = upto, upto + capacity, n + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- solutions

#: A solution: bin pattern (lengths, largest first) -> number of such bins.
Solution = dict


def bins_of(s: Solution) -> int:
    return sum(s.values())


def cost_of(s: Solution, capacity: int) -> tuple[int, float]:
    """Bins first; among equals, a larger sum of squared fill (full bins beside empty ones) is better."""
    return bins_of(s), -sum(c * (sum(p) / capacity) ** 2 for p, c in s.items())


class Supply:
    """Lengths still to place, with counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.lengths = sorted(self.count)
        top = self.lengths[-1] if self.lengths else 0
        self.there = np.zeros(top + 2, bool)
        self.there[self.lengths] = True

    def largest(self, space: int) -> int:
        k = bisect.bisect_right(self.lengths, space)
        return self.lengths[k - 1] if k else 0

    def pair(self, space: int, spare: dict[int, int]) -> tuple[int, int] | None:
        """Two lengths that fill ``space`` exactly, the first as large as possible."""
        high = min(space - 1, len(self.there) - 1)
        low = space - high
        if high < low:
            return None
        both = np.flatnonzero(self.there[low:high + 1] & self.there[low:high + 1][::-1])
        for k in both[::-1][:4]:
            a, b = low + int(k), space - low - int(k)
            if a >= b and spare.get(a, self.count[a]) > (a == b) and spare.get(b, self.count[b]) > 0:
                return a, b
        return None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))
            self.there[length] = False


def _add(s: Solution, pattern: tuple, n: int) -> None:
    if n:
        s[pattern] = s.get(pattern, 0) + n


def best_fit(s: Solution, counts: dict[int, int], capacity: int, rng: np.random.Generator | None = None) -> Solution:
    """Place ``counts`` more lengths: into the tightest gaps of ``s``, then into new bins filled as tightly as can be.

    A pattern is repeated as often as its lengths last, so the work hangs on
    the number of lengths, not of documents. ``rng`` varies the choices.
    """
    supply = Supply(counts)
    gaps: dict[int, list[tuple]] = {}
    for p in s:
        if (gap := capacity - sum(p)) > 0:
            gaps.setdefault(gap, []).append(p)
    for gap in sorted(gaps):
        for p in gaps[gap]:
            left = gap
            while s.get(p) and (x := supply.largest(left)):
                n = min(s[p], supply.count[x])
                supply.take(x, n)
                s[p] -= n
                if not s[p]:
                    del s[p]
                p = tuple(sorted((*p, x), reverse=True))
                _add(s, p, n)
                left -= x
    while supply.lengths:
        x = supply.lengths[-1]
        if rng is not None and rng.random() < 0.1:
            x = supply.lengths[int(rng.integers(len(supply.lengths)))]
        chosen, spare, space = [x], {x: supply.count[x] - 1}, capacity - x
        while space:
            y = bisect.bisect_right(supply.lengths, space)
            while y and spare.get(supply.lengths[y - 1], 1) <= 0:
                y -= 1
            if not y:
                break
            y = supply.lengths[y - 1]
            if y != space and (two := supply.pair(space, spare)) and (rng is None or rng.random() < 0.8):
                add = list(two)
            else:
                add = [y]
            for a in add:
                chosen.append(a)
                spare[a] = spare.get(a, supply.count[a]) - 1
            space = capacity - sum(chosen)
        use = Counter(chosen)
        n = min(supply.count[a] // k for a, k in use.items())
        for a, k in use.items():
            supply.take(a, k * n)
        _add(s, tuple(sorted(chosen, reverse=True)), n)
    return s


def crossover(a: Solution, b: Solution, counts: dict[int, int], capacity: int, rng: np.random.Generator) -> Solution:
    """``a`` with whole well-filled bins of ``b`` injected, duplicates removed and displaced lengths best-fitted."""
    left = dict(counts)
    child: Solution = {}

    def keep(p: tuple, most: int) -> None:
        use = Counter(p)
        n = min(most, min(left[x] // k for x, k in use.items()))
        for x, k in use.items():
            left[x] -= n * k
        _add(child, p, n)

    fills = {p: sum(p) for p in b}
    well = [p for p in b if fills[p] >= 0.995 * capacity] or sorted(b, key=fills.get)[-max(1, len(b) // 2):]
    for k in np.flatnonzero(rng.random(len(well)) < rng.uniform(0.1, 0.6)):
        keep(well[k], b[well[k]])
    for p in sorted(a, key=lambda p: (-sum(p), rng.random())):
        keep(p, a[p])
    return best_fit(child, left, capacity, rng)


def mutate(s: Solution, capacity: int, rng: np.random.Generator) -> Solution:
    """Empty the worst-filled patterns and a few others, and best-fit what they held."""
    out, loose = dict(s), Counter()
    order = sorted(out, key=sum)
    worst = order[:max(1, len(order) // 20)] + [order[int(k)] for k in rng.integers(len(order), size=max(1, len(order) // 10))]
    for p in worst:
        n = out.pop(p, 0)
        for x in p if n else ():
            loose[x] += n
    return best_fit(out, loose, capacity, rng)


def _bounded(s: Solution, capacity: int, max_patterns: int) -> Solution:
    """Empty the rarest patterns where there are too many, and best-fit them into repeated ones."""
    if len(s) <= max_patterns:
        return s
    out, loose = dict(s), Counter()
    for p in sorted(s, key=s.get)[:len(s) - max_patterns // 2]:
        n = out.pop(p)
        for x in p:
            loose[x] += n
    return best_fit(out, loose, capacity)


def evolve(members: list[Solution], counts: dict[int, int], capacity: int, rng: np.random.Generator,
           population: int, generations: int, max_patterns: int) -> list[Solution]:
    """An epoch of one island: best members first."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    members = list(members)
    while len(members) < population:
        members.append(best_fit({}, counts, capacity, rng if members else None))
    members.sort(key=lambda s: cost_of(s, capacity))
    for _ in range(generations):
        if bins_of(members[0]) <= least:
            break
        i, j = rng.integers(population, size=2)
        mother, father = members[min(i, j)], members[int(rng.integers(population))]
        child = crossover(mother, father, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        child = _bounded(child, capacity, max_patterns)
        members = sorted([*members, child], key=lambda s: cost_of(s, capacity))[:population]
    return members[:population]


# ---------------------------------------------------------------- islands on Spark

_STATE = "island int, place int, bins long, cost double, items array<int>, ends array<int>, counts array<long>"


def _row(island: int, place: int, s: Solution, capacity: int) -> dict:
    bins, cost = cost_of(s, capacity)
    return {"island": island, "place": place, "bins": bins, "cost": cost, "items": [x for p in s for x in p],
            "ends": np.cumsum([len(p) for p in s]).tolist(), "counts": list(s.values())}


def _solution(items, ends, counts) -> Solution:
    starts = [0, *ends[:-1]]
    return {tuple(int(x) for x in items[a:b]): int(c) for a, b, c in zip(starts, ends, counts)}


def solve(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 6, epochs: int = 3, generations: int = 40,
          population: int = 6, elites: int = 2, max_patterns: int = 8192, seed: int = 7) -> Solution:
    """Best solution for a histogram of lengths (bounded by ``capacity`` entries)."""
    if not counts:
        return {}

    def epoch_of(epoch: int):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            island = int(g["island"].iloc[0])
            rng = np.random.default_rng([seed, epoch, island])
            g = g[g["place"] >= 0].sort_values(["bins", "cost", "place"])
            members = [_solution(list(i), list(e), list(c)) for i, e, c in zip(g["items"], g["ends"], g["counts"])]
            best = evolve(members[:population], counts, capacity, rng, population, generations, max_patterns)
            return pd.DataFrame([_row(island, k, s, capacity) for k, s in enumerate(best)])

        return run

    state = None
    for epoch in range(epochs):
        if state is None:
            start = spark.range(islands).select(F.col("id").cast("int").alias("island"))
            start = start.selectExpr("island", "-1 as place", "0L as bins", "0D as cost", "array(0) as items", "array(0) as ends", "array(0L) as counts")
        else:
            moved = state.where(F.col("place") < elites).withColumn("island", (F.col("island") + 1) % islands)
            start = state.unionByName(moved)
        state = stored(start.groupBy("island").applyInPandas(epoch_of(epoch), _STATE), "packing-islands")
    best = state.orderBy("bins", "cost", "island", "place").limit(1).first()
    return _solution(list(best["items"]), list(best["ends"]), list(best["counts"]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, **params) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``, gapless in each sequence.

    Pieces are ordered by length in one range exchange; a pattern's slot holds
    a run of consecutive places of its length, so a piece's place alone gives
    its sequence and offset. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "packing-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = solve(spark, counts, capacity, **params)
    next_place = dict(zip(sorted(counts), np.cumsum([0, *[counts[x] for x in sorted(counts)]]).tolist()))
    slots, sequence = [], 0
    for p, n in best.items():
        offset = 0
        for x in p:
            slots.append((next_place[x], sequence, offset))
            next_place[x] += n
            offset += x
        sequence += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 3)

    @F.pandas_udf("sequence_id long, offset long")
    def place(position: pd.Series) -> pd.DataFrame:
        x = position.to_numpy()
        at = np.searchsorted(table[:, 0], x, side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 1] + x - table[at, 0], "offset": table[at, 2]})

    order = [F.col(c) for c in ("length", "doc_id", "piece")]
    out = ranked(pieces, order, "packing-order", "_position").withColumn("_at", place("_position"))
    return out.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def op1_query(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
