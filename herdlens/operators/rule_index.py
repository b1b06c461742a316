"""Rule tables of any size by a q-gram index join (R1-R4, R8 with rules as data).

A rule table is a DataFrame of (ord, label, keyword) rows. A keyword is found
through one of its q-grams: of all of them the one that the fewest texts hold.
A task takes its texts apart into their distinct q-grams and keeps those that a
bitmap of the looked-for ones may hold, so that most never become rows; the rest
meet the keywords in an equi-join. Each candidate is verified by ``contains``, so the index decides
nothing but which pairs are looked at. Hits are summed per rule, then reduced per
record by ``max_by`` or ``min_by``. No rule array is built and nothing but counts and
the bitmap, of a bounded size, reaches the driver. The index is broadcast up to ``broadcast_rows`` counted
keywords, and candidates are verified as they arise; beyond that, q-grams alone
are shuffled (a hot one is split by AQE) and candidates meet their texts again
by row number. An empty or null keyword is no rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators.rules import _texts
from herdlens.sources.tables import ship, stored

#: A keyword's q-grams have the greatest of these lengths, in bytes, that it reaches.
SIZES = (8, 5, 3, 2, 1)
#: Bytes of a text looked at in one go, row groups of stored texts, and bits of the greatest bitmap (as a power of two).
PIECE_BYTES = 1 << 20
GROUP_BYTES = 8 << 20
MAX_BITS = 27


def windows(text: bytes, size: int) -> Iterator[np.ndarray]:
    """All windows of ``size`` bytes (with repeats) as integers, piece by piece; shorter ones than 8 carry their size."""
    for i in range(0, len(text) - size + 1, PIECE_BYTES):
        part = text[i:i + PIECE_BYTES + size - 1]
        n = len(part) - size + 1
        v = np.ndarray(n, "<u8", part + b"\0" * 8, strides=(1,)).copy()
        yield v if size == 8 else (v & np.uint64((1 << 8 * size) - 1)) | np.uint64(size << 56)


def _place(grams: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each q-gram in a bitmap of 2**bits of them."""
    v = grams.astype(np.uint64)
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return v >> np.uint64(64 - bits)


class Bitmap:
    """Bits of the places of given q-grams: 16 or more bits a q-gram, up to 2**MAX_BITS in all."""

    def __init__(self, grams: DataFrame):
        spark = grams.sparkSession
        self.bits = bits = min(MAX_BITS, max(16, (16 * grams.count()).bit_length()))

        @F.pandas_udf("long")
        def place(g: pd.Series) -> pd.Series:
            return pd.Series(_place(g.to_numpy().astype(np.int64), bits).astype(np.int64))

        # At most 2**(MAX_BITS - 3) rows, whatever the number of q-grams.
        found = (grams.select(place("gram").alias("p")).groupBy(F.shiftright("p", 3).alias("byte"))
                 .agg(F.expr("bit_or(shiftleft(1, CAST(p & 7 AS INT)))").alias("v")).toPandas())
        held = np.zeros(1 << (bits - 3), np.uint8)
        held[found["byte"].to_numpy(np.int64)] = found["v"].to_numpy(np.uint8)
        self.held = spark.sparkContext.broadcast(held)

    def __getstate__(self):
        return {"bits": self.bits, "held": self.held}

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        p = _place(grams, self.bits)
        return (self.held.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _grams(text: Column, sizes: Sequence[int], wanted: Bitmap | None = None) -> Column:
    """Distinct windows of the text, of all ``sizes``; with ``wanted``, those that the bitmap may hold."""

    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            kept = [v if wanted is None else v[wanted.may_hold(v)] for s in sizes for v in windows(t, s)]
            out.append(np.unique(np.concatenate(kept)).view(np.int64) if kept else np.empty(0, np.int64))
        return pd.Series(out, dtype=object)

    return grams(text.cast("binary"))


def _size_of(keyword: Column) -> Column:
    out = F.lit(None).cast("int")
    for s in sorted(SIZES):
        out = F.when(F.octet_length(keyword) >= s, F.lit(s)).otherwise(out)
    return out


class RuleIndex:
    """Keyword hits of ``rules`` (``ord_col``, ``label_col``, ``keyword_col``) in the texts of ``df``."""

    def __init__(self, df: DataFrame, text_cols: Sequence[str | Column], rules: DataFrame, ord_col: str = "ord", label_col: str = "disease",
                 keyword_col: str = "kw", lowercase: bool = True, text_transform=None, broadcast_rows: int = 1_000_000):
        ship(df.sparkSession)
        self.columns = df.columns
        texts = _texts(text_cols, lowercase, text_transform)
        # One struct per record, so that its columns can't clash with the helpers'.
        self.rows = stored(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*df.columns).alias("record"),
                                     F.array(*texts).alias("texts")), "rule-rows", GROUP_BYTES)
        kws = (rules.select(F.col(ord_col).cast("long").alias("ord"), F.col(label_col).alias("label"), F.col(keyword_col).cast("string").alias("kw"))
               .where(F.length("kw") > 0).groupBy("ord", "label", "kw").agg(F.count(F.lit(1)).alias("times")))
        self.kws = stored(kws.withColumn("size", _size_of(F.col("kw"))).withColumn("rule_kw", F.monotonically_increasing_id()), "rule-keywords")
        sizes = [r[0] for r in self.kws.select("size").distinct().collect()]  # at most len(SIZES)
        self.broadcast = self.kws.count() <= broadcast_rows
        long = self.rows.select("row", F.posexplode("texts").alias("text_no", "text"))
        self.long = long
        self.sizes = sizes
        self.index = self._index() if sizes else None

    def _found(self, wanted: DataFrame) -> DataFrame:
        """(row, text_no, text, gram): each text's distinct q-grams that the bitmap of ``wanted`` may hold."""
        return self.long.select("row", "text_no", "text", F.explode(_grams(F.col("text"), self.sizes, Bitmap(wanted))).alias("gram"))

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.broadcast else df

    def _index(self) -> DataFrame:
        own = None
        for s in self.sizes:
            g = self.kws.where(F.col("size") == s).select("rule_kw", F.explode(_grams(F.col("kw"), [s])).alias("gram"))
            own = g if own is None else own.unionByName(g)
        own = stored(own, "rule-grams")
        known = stored(own.select("gram").distinct(), "rule-known")
        seen = self._found(known).select("gram").join(self._side(known), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rare = own.join(seen, "gram").groupBy("rule_kw").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        return stored(self.kws.join(rare, "rule_kw").select("gram", "rule_kw", "ord", "label", "kw", "times"), "rule-index")

    def hits(self) -> DataFrame:
        """(row, text_no, ord, label, kw, times): each keyword of a rule that a text holds, once."""
        cols = ["row", "text_no", "ord", "label", "kw", "times"]
        if self.index is None:
            return self.long.where("false").select("row", "text_no", F.lit(0).cast("long").alias("ord"), F.lit("").alias("label"), F.lit("").alias("kw"), F.lit(0).cast("long").alias("times"))
        grams = self._found(self.index.select("gram").distinct())
        if self.broadcast:
            return grams.join(F.broadcast(self.index), "gram").where(F.contains("text", "kw")).select(*cols)
        found = grams.select("row", "text_no", "gram").join(self.index.select("gram", "rule_kw"), "gram").select("row", "text_no", "rule_kw")
        found = found.join(self.kws.select("rule_kw", "ord", "label", "kw", "times"), "rule_kw")
        return found.join(self.long, ["row", "text_no"]).where(F.contains("text", "kw")).select(*cols)

    def scores(self, mode: str = "each") -> DataFrame:
        """(row, ord, label, score) of every rule with a hit; ``any`` counts a keyword once for all texts."""
        if mode not in ("each", "any"):
            raise ValueError(f"unknown scoring mode {mode!r}")
        hits = self.hits()
        if mode == "any":
            hits = hits.groupBy("row", "ord", "label", "kw").agg(F.max("times").alias("times"))
        return hits.groupBy("row", "ord", "label").agg(F.sum("times").alias("score"))

    def _with(self, best: DataFrame, out_col: str, fallback: str | None) -> DataFrame:
        out = self.rows.select("row", "record").join(best, "row", "left").select("record", F.coalesce("best", F.lit(fallback)).alias("best"))
        return out.select(*[F.col("record").getField(c).alias(c) for c in self.columns if c != out_col], F.col("best").alias(out_col))


def keyword_scores(df: DataFrame, id_cols: Sequence[str], text_cols: Sequence[str | Column], rules: DataFrame, mode: str = "each", **options) -> DataFrame:
    """(ids..., ord, label, score) of the rules with a hit; a rule without one has no row."""
    ix = RuleIndex(df, text_cols, rules, **options)
    return ix.scores(mode).join(ix.rows.select("row", "record"), "row").select(*[F.col("record").getField(c).alias(c) for c in id_cols], "ord", "label", "score")


def keyword_top1(df: DataFrame, text_cols: Sequence[str | Column], rules: DataFrame, mode: str = "each", out_col: str = "disease",
                 fallback: str = FV.NO_MATCH_LABEL, **options) -> DataFrame:
    """Adds the label of the highest score; ties go to the smallest ord, no hit gives the fallback."""
    ix = RuleIndex(df, text_cols, rules, **options)
    best = ix.scores(mode).groupBy("row").agg(F.max_by("label", F.struct("score", -F.col("ord"))).alias("best"))
    return ix._with(best, out_col, fallback)


def first_match_label(df: DataFrame, text_cols: Sequence[str | Column], rules: DataFrame, out_col: str = "label", **options) -> DataFrame:
    """Adds the label of the smallest ord with a keyword in any text, else null."""
    ix = RuleIndex(df, text_cols, rules, **{"label_col": "label", **options})
    best = ix.hits().groupBy("row").agg(F.min_by("label", "ord").alias("best"))
    return ix._with(best, out_col, None)
