"""Keyword rule scoring (first-match label, per-disease scores, top-1).

A rule table is an array of (order, label, keywords) structs: a literal for
the fixed tables, a scalar subquery for a rule table given as a DataFrame. Every
record is scored in one narrow projection by array functions over it, so the
expression stays small however many rules there are: no join, no shuffle, no
Python, and nothing that depends on session settings. The normalised texts are
bound once per record as a lambda variable.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.functions.text import col_, symptom_text


@dataclass(frozen=True)
class KeywordTable:
    """Ordered (label, keywords) rules; rule order breaks score ties."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]
    fallback: str = FV.NO_MATCH_LABEL

    @staticmethod
    def of(entries: Sequence[tuple[str, Sequence[str]]], fallback: str = FV.NO_MATCH_LABEL):
        return KeywordTable(tuple((d, tuple(k)) for d, k in entries), fallback)

    def n_keywords(self) -> int:
        return sum(len(k) for _, k in self.entries)


DISEASES_26 = KeywordTable.of(FV.DISEASE_KEYWORDS, FV.NO_MATCH_LABEL)
DISEASES_6 = KeywordTable.of(FV.DISEASE_KEYWORDS_SIX, FV.NO_MATCH_LABEL_SIX)
DISEASES_8 = KeywordTable.of(FV.DISEASE_KEYWORDS_EIGHT, FV.NO_MATCH_LABEL_EIGHT)
TEXT_MARKERS = KeywordTable.of(FV.TEXT_RULES, FV.TEXT_NO_MATCH_LABEL)


def rules_from_df(rules: DataFrame, label_col: str = "disease", keyword_col: str = "kw",
                  order_col: str = "ord") -> Column:
    """A rule DataFrame (one row per keyword) as a rule array; it stays a scalar subquery."""
    per_rule = (rules.groupBy(F.col(order_col).cast("int").alias("ord"), F.col(label_col).alias("disease"))
                .agg(F.sort_array(F.collect_list(F.col(keyword_col))).alias("kws")))
    return per_rule.agg(F.sort_array(F.collect_list(F.struct("ord", "disease", "kws")))).scalar()


def _texts(text_cols: Sequence[str | Column], lowercase: bool = True,
           text_transform=None) -> list[Column]:
    if text_transform is not None:
        return [F.coalesce(text_transform(col_(c).cast("string")), F.lit("")) for c in text_cols]
    if lowercase:
        return [symptom_text(c) for c in text_cols]
    return [F.coalesce(col_(c).cast("string"), F.lit("")) for c in text_cols]


def sql_str(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit(text: str, kw: str) -> str:
    # contains() tests the first byte before comparing; instr() compares at every position.
    return f"contains({text}, {sql_str(kw)})"


def rules_literal(table: KeywordTable) -> Column:
    """The rule array of a fixed table; generated as SQL text, which one parse turns into a literal."""
    rules = ", ".join(
        f"named_struct('ord', {i}, 'disease', {sql_str(label)}, 'kws', "
        f"CAST(array({', '.join(map(sql_str, kws))}) AS ARRAY<STRING>))"
        for i, (label, kws) in enumerate(table.entries, start=1))
    return F.expr(f"CAST(array({rules}) AS ARRAY<STRUCT<ord: INT, disease: STRING, kws: ARRAY<STRING>>>)")


def _bound(texts: Sequence[Column], fn) -> Column:
    """``fn`` of the texts as fields of one lambda variable: they are evaluated once per record."""
    one = F.array(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)]))
    return F.element_at(F.transform(one, lambda x: fn([x[f"t{i}"] for i in range(len(texts))])), 1)


def _score(rule: Column, texts: Sequence[Column], mode: str) -> Column:
    """Hits of a rule's keywords: per text (``each``) or once for all texts (``any``)."""
    if mode not in ("each", "any"):
        raise ValueError(f"unknown scoring mode {mode!r}")

    def hits(kw: Column) -> Column:
        found = [F.contains(t, kw) for t in texts]
        if mode == "any":
            any_ = found[0]
            for f in found[1:]:
                any_ = any_ | f
            return any_.cast("int")
        total = found[0].cast("int")
        for f in found[1:]:
            total = total + f.cast("int")
        return total

    return F.aggregate(rule["kws"], F.lit(0), lambda n, kw: n + hits(kw))


def _with_rules(df: DataFrame, table: KeywordTable | Column) -> tuple[DataFrame, Column]:
    """The rule array as an expression; a subquery becomes a column first (array functions take none)."""
    if isinstance(table, KeywordTable):
        return df, rules_literal(table)
    return df.withColumn("__rules", table), F.col("__rules")


def first_match_sql(rules: Sequence[tuple[str, str]], texts: Sequence[str]) -> str:
    """Label of the first rule whose keyword is in any text; none -> null."""
    whens = " ".join(
        f"WHEN {' OR '.join(_hit(t, kw) for t in texts)} THEN {sql_str(label)}" for kw, label in rules)
    return f"CASE {whens} ELSE CAST(NULL AS STRING) END"


def _with_texts(df: DataFrame, text_cols, lowercase=True, text_transform=None):
    texts = _texts(text_cols, lowercase, text_transform)
    names = [f"__text{i}" for i in range(len(texts))]
    return df.withColumns(dict(zip(names, texts))), names


def keyword_scores(df: DataFrame, id_cols: Sequence[str], text_cols: Sequence[str | Column],
                   table: KeywordTable | Column = DISEASES_26, mode: str = "each",
                   lowercase: bool = True, text_transform=None) -> DataFrame:
    """Long form ``(id..., ord, disease, score)``: one row per record and rule entry (narrow ``inline``).

    A rule without keywords scores 0.
    """
    texts = _texts(text_cols, lowercase, text_transform)
    df, rule_array = _with_rules(df, table)
    scored = _bound(texts, lambda ts: F.transform(rule_array, lambda r: F.struct(
        r["ord"].alias("ord"), r["disease"].alias("disease"), _score(r, ts, mode).alias("score"))))
    return df.select(*id_cols, F.inline(scored))


def keyword_top1(df: DataFrame, text_cols: Sequence[str | Column],
                 table: KeywordTable | Column = DISEASES_26, mode: str = "each",
                 out_col: str = "disease", lowercase: bool = True,
                 fallback: str | None = None, text_transform=None) -> DataFrame:
    """Adds ``out_col`` with the best rule label of each row (narrow, no shuffle).

    The highest score wins, ties go to the earliest rule, and all scores zero
    give the fallback. ``text_transform`` replaces the default request
    normalisation (strip + lower); long texts only need ``F.lower`` since
    stripping cannot change a substring hit.
    """
    texts = _texts(text_cols, lowercase, text_transform)
    if fallback is None:
        fallback = table.fallback if isinstance(table, KeywordTable) else FV.NO_MATCH_LABEL
    df, rule_array = _with_rules(df, table)
    best = _bound(texts, lambda ts: F.array_max(F.transform(rule_array, lambda r: F.struct(
        _score(r, ts, mode).alias("score"), (-r["ord"]).alias("early"), r["disease"].alias("disease")))))
    return (df.withColumn("__best", best)
            .withColumn(out_col, F.when(F.col("__best.score") > 0, F.col("__best.disease")).otherwise(F.lit(fallback)))
            .drop("__best", "__rules"))


def first_match_label(df: DataFrame, text_cols: Sequence[str | Column],
                      rules: Sequence[tuple[str, str]] = FV.SYMPTOM_LABEL_RULES,
                      out_col: str = "label") -> DataFrame:
    df2, names = _with_texts(df, text_cols)
    return df2.withColumn(out_col, F.expr(first_match_sql(rules, names))).drop(*names)


def combined_diagnosis_rule_part(df: DataFrame, bp: str = "bp",
                                 heart_rate: Sequence[str] = FV.HEART_RATE_NAMES,
                                 age: Sequence[str] = FV.AGE_NAMES, symptoms=("symptom_1", "symptom_2"),
                                 rules: Sequence[tuple[str, str]] = FV.SYMPTOM_LABEL_RULES) -> DataFrame:
    """Rule part of the combined diagnosis on blank-normalised records.

    Vitals are parsed before any symptom is looked at: systolic = text before
    the first ``/`` (blank fails), heart rate and age = the first alias column
    given, else 0 (a 0 falls through to the next). Any
    parse failure gives the fixed healthy label even when a symptom matches.
    Otherwise a quick-label hit gives ``label + rule mark``; rows that need the
    model get ``prediction = null`` and ``needs_model = true``.
    """
    from herdlens.functions.bp import bp_part
    from herdlens.functions.numbers import to_double
    from herdlens.operators.filters import alias_value

    def or_zero_ok(names: Sequence[str]) -> Column:
        return to_double(alias_value(df, names, "0", zero_falls_through=True)).isNotNull()

    parse_ok = (to_double(bp_part(F.coalesce(F.col(bp), F.lit("")), 1)).isNotNull()
                & or_zero_ok(heart_rate) & or_zero_ok(age))
    df2, names = _with_texts(df, list(symptoms))
    return (df2.withColumn("parse_ok", parse_ok)
            .withColumn("_quick", F.expr(first_match_sql(rules, names))).drop(*names)
            .withColumn("prediction",
                        F.when(~F.col("parse_ok"), F.lit(FV.PARSE_ERROR_LABEL))
                        .when(F.col("_quick").isNotNull(),
                              F.concat(F.col("_quick"), F.lit(FV.RULE_MARK))))
            .withColumn("needs_model", F.col("parse_ok") & F.col("_quick").isNull())
            .drop("_quick"))


def _catalogue_rows() -> Column:
    return F.array(*[
        F.struct(F.lit(i).cast("int").alias("ord"), F.lit(g).alias("vaccine_group"),
                 F.lit(v).alias("vaccine"))
        for i, (g, v) in enumerate(FV.VACCINE_CATALOGUE, start=1)])


def vaccine_catalogue(df: DataFrame, id_col: str = "animal_id") -> DataFrame:
    """The fixed catalogue listed for every animal (narrow ``inline``)."""
    return df.select(id_col, F.inline(_catalogue_rows()))


def vaccine_recommend(df: DataFrame, id_col: str = "animal_id", species_col: str = "species",
                      mapping: Sequence[tuple[str, str]] = FV.SPECIES_SIZE_GROUP) -> DataFrame:
    """Catalogue entries of the species' size group (unknown species: none).

    The species mapping is a literal map, so this stays a narrow projection.
    """
    groups = F.create_map(*[x for sp, g in mapping for x in (F.lit(sp), F.lit(g))])
    return (df.select(id_col, species_col, F.try_element_at(groups, F.col(species_col)).alias("_g"),
                      F.inline(_catalogue_rows()))
            .where(F.col("vaccine_group") == F.col("_g"))
            .select(id_col, species_col, "ord", "vaccine"))


def health_verdict(df: DataFrame, label_col: str, out_col: str = "verdict") -> DataFrame:
    """Healthy label -> healthy text; other non-empty label -> attention text; else null."""
    c = F.col(label_col)
    return df.withColumn(out_col, F.when(c == F.lit("Healthy"), F.lit(FV.VERDICT_HEALTHY))
                         .when(F.coalesce(c, F.lit("")) != F.lit(""), F.lit(FV.VERDICT_ATTENTION)))
