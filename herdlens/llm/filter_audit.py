"""Filter interaction audit by a Gray-code walk over the subsets of filters.

Five filters are decided per document; the set of those it fails is its mask.
Documents are counted per (part, mask): at most 32 cells a part, by partial
sums. Each part then walks all 32 subsets of filters in Gray-code order, so
that neighbouring subsets differ in one filter: every cell keeps the number of
active filters it fails, and toggling a filter moves only the cells whose
number reaches or leaves zero in or out of the running survivors. The 32 states
are kept; a step of any filter order is the difference of two of them.

Exact duplicates are found by a 160-bit identity of the text (SHA-1), so no
text is shuffled; a text's smallest id is a partial minimum, joined back where
AQE splits a text with many copies.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored, text_of

WORDS = r"[^\x20\x09-\x0D]+"
#: Filters by bit of the mask.
LETTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that a text decides alone; ``text`` isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n,
        "C": F.lit(100) * (F.length(text) - F.length(F.translate(text, _UPPER, ""))) > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) per row of ``docs``; good and toxic are 1 if a label row of the id says so."""
    t = text_of(docs, text)
    alone = failures(F.col("t"))
    mask = sum((F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in alone.items()), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"))
    rows = stored(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha1(F.encode("t", "utf-8"))).alias("same")), "audit-masks")
    first = rows.groupBy("same").agg(F.min("id").alias("first"))
    rows = rows.join(first, "same").select("id", "part", F.when(F.col("id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null and (quality = 1 or toxic = 1)")
             .groupBy("id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    return rows.join(marks, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per cell."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def gray_states(masks_: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters: row s has the sums of ``counts`` over cells that fail none of s.

    One filter is toggled from subset to subset.
    """
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks_), np.int64)
    running = counts.sum(axis=0)
    states[0] = running
    subset = 0
    for step in range(1, 1 << filters):
        f = (step & -step).bit_length() - 1
        subset ^= 1 << f
        hit = masks_ >> f & 1 == 1
        if subset >> f & 1:
            running = running - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[hit & (failing == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(masks_: np.ndarray, counts: np.ndarray, letters: str = LETTERS) -> pd.DataFrame:
    """Rows of every order and step, from the cells (mask; n, good, toxic) of one part."""
    k = len(letters)
    states = gray_states(masks_, counts, k)
    fails = [int(counts[masks_ >> f & 1 == 1, 0].sum()) for f in range(k)]
    alone = [int(counts[masks_ == 1 << f, 0].sum()) for f in range(k)]
    orders = np.array(list(permutations(range(k))))
    f = orders.ravel()
    after = np.cumsum(1 << orders, axis=1)
    before = (after - (1 << orders)).ravel()
    after = after.ravel()
    lost = states[before] - states[after]
    shapley = np.bincount(f, lost[:, 0], k).astype(np.int64)  # sums of counts, exact below 2**53
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(letters[i] for i in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": states[after, 0], "removed": lost[:, 0], "redundant": np.array(fails)[f] - lost[:, 0], "unique_fails": np.array(alone)[f],
        "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": shapley[f]})


_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, filter order and step.

    A null text is empty, a null part the empty string. E compares ids: rows of
    one text with the same id don't fail it for each other, a null id neither
    fails it nor makes others fail. Repeated rows count each. An id with
    several label rows is good (toxic) if one of them says so; label rows with
    a null id count for nobody. An empty table has no parts and gives no rows.
    """

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        out = steps(g["mask"].to_numpy(np.int64), g[["n", "good", "toxic"]].to_numpy(np.int64))
        out.insert(0, "part", g["part"].iloc[0])
        return out

    return cells(masks(docs, labels, key, text, part)).groupBy("part").applyInPandas(walk, _SCHEMA)


def op12_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) AS b,
  CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
  CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS e FROM d),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * coalesce(e, 0) AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN lab ON lab.doc_id = f.doc_id GROUP BY 1, 2),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM k p, k q, k r, k s, k t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
st AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
ord AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM st),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & CAST(before + bit AS INT) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & CAST(before AS INT) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, ord GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
