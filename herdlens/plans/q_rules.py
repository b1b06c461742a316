"""Rule / scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdlens import fixed_values as FV
from herdlens.operators import clean, rule_index, rules
from herdlens.plans import sql_parts as S
from herdlens.plans.registry import query
from herdlens.sources import views

_RULES26 = f"rules(ord, disease, kw) AS ({S.keyword_values(FV.DISEASE_KEYWORDS)})"
_RULES6 = f"rules(ord, disease, kw) AS ({S.keyword_values(FV.DISEASE_KEYWORDS_SIX)})"
_TEXT_RULES = f"rules(ord, disease, kw) AS ({S.keyword_values(FV.TEXT_RULES)})"
_LABEL_RULES = f"lrules(ord, kw, label) AS ({S.pair_values(FV.SYMPTOM_LABEL_RULES)})"

_REQ = f"""req AS (SELECT animal_id, {S.sym('symptom_1')} AS s1, {S.sym('symptom_2')} AS s2 FROM animal)"""


def _top1_sql(fallback: str, id_col: str = "animal_id") -> str:
    return (f"SELECT {id_col}, CASE WHEN max(score) > 0 THEN arg_max(disease, score * 100000 - ord) "
            f"ELSE {S.q(fallback)} END AS disease FROM sc GROUP BY {id_col}")


@query("keyword_scores", S.with_(S.ANIMAL, _RULES26, _REQ, """sc AS (
 SELECT q.animal_id, CAST(r.ord AS INT) AS ord, r.disease,
  CAST(sum(CAST(contains(q.s1, r.kw) AS INT) + CAST(contains(q.s2, r.kw) AS INT)) AS INT) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""") + "SELECT * FROM sc")
def keyword_scores(spark, sf_dir):
    return rules.keyword_scores(views.animal(spark, sf_dir), ["animal_id"],
                                ["symptom_1", "symptom_2"], rules.DISEASES_26, mode="each")


@query("keyword_scores_any", S.with_(S.ANIMAL, _RULES6, _REQ, """sc AS (
 SELECT q.animal_id, CAST(r.ord AS INT) AS ord, r.disease,
  CAST(sum(CAST(contains(q.s1, r.kw) OR contains(q.s2, r.kw) AS INT)) AS INT) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""") + "SELECT * FROM sc")
def keyword_scores_any(spark, sf_dir):
    return rules.keyword_scores(views.animal(spark, sf_dir), ["animal_id"],
                                ["symptom_1", "symptom_2"], rules.DISEASES_6, mode="any")


@query("keyword_top1", S.with_(S.ANIMAL, _RULES26, _REQ, """sc AS (
 SELECT q.animal_id, r.ord, r.disease,
  sum(CAST(contains(q.s1, r.kw) AS INT) + CAST(contains(q.s2, r.kw) AS INT)) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""") + _top1_sql(FV.NO_MATCH_LABEL))
def keyword_top1(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    return rules.keyword_top1(a, ["symptom_1", "symptom_2"], rules.DISEASES_26).select(
        "animal_id", "disease")


@query("keyword_top1_any", S.with_(S.ANIMAL, _RULES6, _REQ, """sc AS (
 SELECT q.animal_id, r.ord, r.disease,
  sum(CAST(contains(q.s1, r.kw) OR contains(q.s2, r.kw) AS INT)) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""") + _top1_sql(FV.NO_MATCH_LABEL_SIX))
def keyword_top1_any(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    return rules.keyword_top1(a, ["symptom_1", "symptom_2"], rules.DISEASES_6, mode="any").select(
        "animal_id", "disease")


_RULES8 = f"rules(ord, disease, kw) AS ({S.keyword_values(FV.DISEASE_KEYWORDS_EIGHT)})"


@query("keyword_top1_eight", S.with_(S.ANIMAL, _RULES8, _REQ, """sc AS (
 SELECT q.animal_id, r.ord, r.disease,
  sum(CAST(contains(q.s1, r.kw) AS INT) + CAST(contains(q.s2, r.kw) AS INT)) AS score
 FROM req q CROSS JOIN rules r GROUP BY q.animal_id, r.ord, r.disease)""") + """
SELECT animal_id, CASE WHEN max(score) > 0 THEN arg_max(disease, score * 100000 - ord)
 ELSE 'Unknown Disease' END AS disease FROM sc GROUP BY animal_id""")
def keyword_top1_eight(spark, sf_dir):
    """The 8-disease table, given as a rule DataFrame."""
    rows = [(i, label, kw) for i, (label, kws) in enumerate(FV.DISEASE_KEYWORDS_EIGHT, 1) for kw in kws]
    table = rules.rules_from_df(spark.createDataFrame(rows, "ord int, disease string, kw string"))
    return rules.keyword_top1(views.animal(spark, sf_dir), ["symptom_1", "symptom_2"], table,
                              fallback=FV.NO_MATCH_LABEL_EIGHT).select("animal_id", "disease")


@query("first_match_label", S.with_(S.ANIMAL, _LABEL_RULES, _REQ, """hit AS (
 SELECT q.animal_id, min(r.ord) AS ord FROM req q JOIN lrules r
   ON contains(q.s1, r.kw) OR contains(q.s2, r.kw) GROUP BY q.animal_id)""") + """
SELECT a.animal_id, r.label FROM animal a LEFT JOIN hit h ON a.animal_id = h.animal_id
LEFT JOIN lrules r ON r.ord = h.ord""")
def first_match_label(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    return rules.first_match_label(a, ["symptom_1", "symptom_2"]).select("animal_id", "label")


@query("first_match_rule_table", S.with_(S.ANIMAL, _LABEL_RULES, _REQ, """hit AS (
 SELECT q.animal_id, min(r.ord) AS ord FROM req q JOIN lrules r
   ON contains(q.s1, r.kw) OR contains(q.s2, r.kw) GROUP BY q.animal_id)""") + """
SELECT a.animal_id, r.label FROM animal a LEFT JOIN hit h ON a.animal_id = h.animal_id
LEFT JOIN lrules r ON r.ord = h.ord""")
def first_match_rule_table(spark, sf_dir):
    """The label rules as a rule DataFrame."""
    table = spark.createDataFrame([(i, kw, label) for i, (kw, label) in enumerate(FV.SYMPTOM_LABEL_RULES, 1)], "ord int, kw string, label string")
    a = views.animal(spark, sf_dir).select("animal_id", "symptom_1", "symptom_2")
    return rule_index.first_match_label(a, ["symptom_1", "symptom_2"], table).select("animal_id", "label")


# Every passage of four words of a benchmark item is a keyword of that item.
_PASSAGE_RULES = """bw AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
rules AS (SELECT item_id AS ord, CAST(item_id AS VARCHAR) AS disease, array_to_string(w[i:i + 3], ' ') AS kw
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 2, 1))) AS i FROM bw))"""


def passage_rules(spark, sf_dir):
    w = views.read_table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w")).where(F.size("w") >= 4)
    kw = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " ")))
    return w.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("disease"), kw.alias("kw"))


@query("keyword_top1_rule_table", S.with_(_PASSAGE_RULES, """sc AS (
 SELECT d.doc_id, r.ord, r.disease, sum(CAST(contains(lower(d.text), r.kw) AS INT)) AS score
 FROM documents d CROSS JOIN rules r GROUP BY d.doc_id, r.ord, r.disease)""")
       + _top1_sql("none", "doc_id"))
def keyword_top1_rule_table(spark, sf_dir):
    """Whole documents against a rule table made of the benchmark's passages: the item with most passages in a document."""
    d = views.documents(spark, sf_dir).select("doc_id", "text")
    return rule_index.keyword_top1(d, ["text"], passage_rules(spark, sf_dir), fallback="none", text_transform=F.lower).select("doc_id", "disease")


_LABEL_RULES9 = f"lrules(ord, kw, label) AS ({S.pair_values(FV.SYMPTOM_LABEL_RULES_NO_EYE)})"


@query("first_match_label_nine", S.with_(S.ANIMAL, _LABEL_RULES9, _REQ, """hit AS (
 SELECT q.animal_id, min(r.ord) AS ord FROM req q JOIN lrules r
   ON contains(q.s1, r.kw) OR contains(q.s2, r.kw) GROUP BY q.animal_id)""") + """
SELECT a.animal_id, r.label FROM animal a LEFT JOIN hit h ON a.animal_id = h.animal_id
LEFT JOIN lrules r ON r.ord = h.ord""")
def first_match_label_nine(spark, sf_dir):
    a = views.animal(spark, sf_dir)
    return rules.first_match_label(a, ["symptom_1", "symptom_2"], FV.SYMPTOM_LABEL_RULES_NO_EYE).select("animal_id", "label")


@query("keyword_top1_documents", S.with_(_TEXT_RULES, """sc AS (
 SELECT d.doc_id, r.ord, r.disease, sum(CAST(contains(lower(d.text), r.kw) AS INT)) AS score
 FROM documents d CROSS JOIN rules r GROUP BY d.doc_id, r.ord, r.disease)""")
       + _top1_sql(FV.TEXT_NO_MATCH_LABEL, "doc_id"))
def keyword_top1_documents(spark, sf_dir):
    d = views.documents(spark, sf_dir).select("doc_id", "text")
    return rules.keyword_top1(d, ["text"], rules.TEXT_MARKERS, lowercase=False,
                              text_transform=F.lower).select("doc_id", "disease")


@query("keyword_top1_conversations", S.with_(_TEXT_RULES, """sc AS (
 SELECT c.conv_id, c.turn, r.ord, r.disease, sum(CAST(contains(lower(c.text), r.kw) AS INT)) AS score
 FROM conversations c CROSS JOIN rules r GROUP BY c.conv_id, c.turn, r.ord, r.disease)""") + f"""
SELECT conv_id, turn, CASE WHEN max(score) > 0 THEN arg_max(disease, score * 100000 - ord)
 ELSE {S.q(FV.TEXT_NO_MATCH_LABEL)} END AS disease FROM sc GROUP BY conv_id, turn""")
def keyword_top1_conversations(spark, sf_dir):
    c = views.conversations(spark, sf_dir).select("conv_id", "turn", "text")
    return rules.keyword_top1(c, ["text"], rules.TEXT_MARKERS, lowercase=False,
                              text_transform=F.lower).select("conv_id", "turn", "disease")


def _norm(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR lower(CAST({c} AS VARCHAR)) = 'nan' THEN '' ELSE CAST({c} AS VARCHAR) END"


_DIAG_RULES_SQL = S.with_(S.ANIMAL, S.DIRTY, _LABEL_RULES, f"""n AS (
 SELECT animal_id, {_norm('bp')} AS bp, {S.given('heart_rate', 'heart_rate_bpm', zero_falls_through=True)} AS hr,
  {S.given('age_years', 'age', zero_falls_through=True)} AS age,
  {S.sym(_norm('symptom_1'))} AS s1, {S.sym(_norm('symptom_2'))} AS s2 FROM dirty WHERE copy_no = 0)""", f"""p AS (
 SELECT animal_id, s1, s2,
  ({S.num("split_part(bp, '/', 1)")}) IS NOT NULL
  AND (hr = '' OR ({S.num('hr')}) IS NOT NULL)
  AND (age = '' OR ({S.num('age')}) IS NOT NULL) AS parse_ok FROM n)""", """hit AS (
 SELECT p.animal_id, min(r.ord) AS ord FROM p JOIN lrules r
   ON contains(p.s1, r.kw) OR contains(p.s2, r.kw) GROUP BY p.animal_id)""") + f"""
SELECT p.animal_id,
 CASE WHEN NOT p.parse_ok THEN {S.q(FV.PARSE_ERROR_LABEL)}
      WHEN r.label IS NOT NULL THEN r.label || {S.q(FV.RULE_MARK)} END AS prediction,
 p.parse_ok AND r.label IS NULL AS needs_model
FROM p LEFT JOIN hit h ON p.animal_id = h.animal_id LEFT JOIN lrules r ON r.ord = h.ord"""


@query("combined_diagnosis_rules", _DIAG_RULES_SQL)
def combined_diagnosis_rules(spark, sf_dir):
    a = views.dirty_animal(spark, sf_dir).where("copy_no = 0").drop("copy_no")
    a = clean.blank_normalise(a, [c for c in a.columns if c != "animal_id"])
    return rules.combined_diagnosis_rule_part(a).select("animal_id", "prediction", "needs_model")


@query("vaccine_catalogue", S.with_(S.ANIMAL, f"cat(ord, grp, vaccine) AS ({S.pair_values(FV.VACCINE_CATALOGUE)})") + """
SELECT a.animal_id, CAST(c.ord AS INT) AS ord, c.grp AS vaccine_group, c.vaccine FROM animal a CROSS JOIN cat c""")
def vaccine_catalogue(spark, sf_dir):
    return rules.vaccine_catalogue(views.animal(spark, sf_dir).select("animal_id"))


@query("vaccine_recommend", S.with_(S.ANIMAL,
       f"cat(ord, grp, vaccine) AS ({S.pair_values(FV.VACCINE_CATALOGUE)})",
       f"sz(o, species, grp) AS ({S.pair_values(FV.SPECIES_SIZE_GROUP)})") + """
SELECT a.animal_id, a.species, CAST(c.ord AS INT) AS ord, c.vaccine FROM animal a
JOIN sz ON sz.species = a.species JOIN cat c ON c.grp = sz.grp""")
def vaccine_recommend(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "species")
    return rules.vaccine_recommend(a)


@query("health_verdict", S.with_(S.ANIMAL) + f"""
SELECT animal_id, health_status,
 CASE WHEN health_status = 'Healthy' THEN '🟢 The animal appears healthy.'
      WHEN coalesce(health_status, '') <> '' THEN '🔴 The animal may need medical attention.' END AS verdict
FROM animal""")
def health_verdict(spark, sf_dir):
    a = views.animal(spark, sf_dir).select("animal_id", "health_status")
    return rules.health_verdict(a, "health_status")
