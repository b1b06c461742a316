"""Mix sources to target weights: per-source repetition rates, whole copies plus one Bernoulli copy.

Sizes are counted per document and summed per source (partial sums first, so
a hot source never meets in one task). A source's target is its weight's part
of the budget, at most ``max_repeat`` times its size; the excess goes to the
others by weight until none is above. Every document is then emitted
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``,
decided by a hash of its id, text and number among equal rows, so reruns agree. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import ranked, small, stored, text_of

#: Runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def hash_unit(key: Column, seed: str) -> Column:
    """A double in [0, 1) from md5 of ``seed`` and the key (52 bits)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources are ordered by code point with null last and take ``weights`` in
    turn. The water level rises in rounds: each round caps the sources whose
    share passes ``max_repeat`` times their size and shares the rest anew; it
    ends when a round caps no further source.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    per = ranked(per, [F.col("source").asc_nulls_last()], "mix-sources")
    at = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select("source", "source_size",
                     F.element_at(at, (F.col("position") % len(weights) + 1).cast("int")).alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, -1
    capped = F.lit(False)
    while True:
        row = per.agg(F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
                      F.sum(F.when(capped, cap).otherwise(0.0)).alias("full"),
                      F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if (row["n"] or 0) == known or not row["open"]:
            break
        known = row["n"]
        level = (budget_share * total - row["full"]) / row["open"]
        capped = F.col("weight") * F.lit(level) >= cap
    return per.select("source", "source_size",
                      F.when(capped, cap).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _numbered(rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` (id, print, ..) with ``number``: a running number from 0 among rows equal in id and print.

    Only rows that have an equal are ranked, by range partitions, so a hot id
    meets in no task.
    """
    keys = rows.groupBy("id", "print").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias("_id"), F.col("print").alias("_print"))
    again = stored(keys, "mix-repeated")
    n = again.count()
    if n == 0:
        return rows.withColumn("number", F.lit(0).cast("long"))
    same = rows["id"].eqNullSafe(again["_id"]) & (rows["print"] == again["_print"])
    side = small(again, n, broadcast_rows)
    placed = stored(ranked(rows.join(side, same, "left_semi"), [F.col("id"), F.col("print")], "mix-rows"), "mix-placed")
    first = placed.groupBy(F.col("id").alias("_id"), F.col("print").alias("_print")).agg(F.min("position").alias("_first"))
    first = small(first, n, broadcast_rows)
    placed = placed.join(first, placed["id"].eqNullSafe(first["_id"]) & (placed["print"] == first["_print"]))
    placed = placed.withColumn("number", F.col("position") - F.col("_first")).select(*rows.columns, "number")
    return rows.join(side, same, "left_anti").withColumn("number", F.lit(0).cast("long")).unionByName(placed)


def drawn(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, max_repeat: float = 2.0,
          seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` (id, print, source, size, ..) with ``source_size``, ``target`` and ``copies`` (how often each goes in).

    ``print`` identifies a text. A null source is a source of its own. Every row
    draws for itself, by its id, its text and a running number among equal rows,
    so a source of one id comes near its target too and reruns agree. The
    per-source table is broadcast up to ``broadcast_rows`` counted rows; beyond
    that it is joined, where AQE splits a hot source.
    """
    targets = stored(source_targets(rows.select("source", "size"), weights, budget_share, max_repeat), "mix-targets")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    out = _numbered(rows, broadcast_rows)
    out = out.join(small(t, targets.count(), broadcast_rows), F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
    whole = F.floor("rate")
    draw = hash_unit(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "print", "number"), seed)
    return (out.withColumn("copies", whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0))
            .select(*rows.columns, "source_size", "target", "copies"))


def sized(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    """id, print, source and size of a document; a null text has size 0."""
    return [F.col(key).cast("long").alias("id"), F.md5(F.encode(text_of(docs, text), "utf-8")).alias("print"), F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size")]


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """Each row of ``docs`` as often as it goes into the mix; columns of any name stay. An empty table gives an empty table."""
    rows = docs.select(*sized(docs, key, text, source), F.struct(*docs.columns).alias("record"))
    rows = drawn(rows, **params).where(F.col("copies") > 0)
    return rows.select("record", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("record.*")


def op6_query(docs: DataFrame) -> DataFrame:
    rows = stored(docs.select(*sized(docs, "doc_id", "text", "source")), "mix-sizes")
    out = drawn(rows)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS print,
        row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS number, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
num AS (SELECT source, source_size,
          CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM per),
run AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM num),
lev AS (SELECT ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))
                       / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
        FROM run WINDOW w AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
pick AS (SELECT arg_min(level, ratio) AS level FROM lev WHERE level < ratio),
t AS (SELECT source, source_size, CASE WHEN weight * level >= cap THEN cap ELSE weight * level END AS target FROM run, pick),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0 END AS rate,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.print || ':' || d.number), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
