"""Building blocks of the DuckDB oracle SQL (views as CTEs, rule VALUES lists).

The CTE texts are the view definitions stated in FIXTURES.md; they run in
DuckDB over the pre-registered base tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from herdlens import fixed_values as FV

ANIMAL = """animal AS (
SELECT c_custkey AS animal_id, c_name AS name,
 split_part('Cat,Buffalo,Goat,Sheep,Dog,Hen,Cow', ',', CAST(c_custkey % 7 + 1 AS INT)) AS species,
 c_mktsegment AS breed,
 split_part('Male,Female', ',', CAST(c_custkey % 2 + 1 AS INT)) AS sex,
 CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(c_custkey % 15 AS STRING) END AS age_years,
 CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'unknown'
      WHEN c_custkey % 29 = 0 THEN CAST(90 + c_custkey % 60 AS STRING)
      ELSE concat(CAST(90 + c_custkey % 60 AS STRING), '/', CAST(50 + (c_custkey * 7) % 45 AS STRING)) END AS bp,
 CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 47 = 0 THEN 'abc'
      ELSE CAST(40 + (c_custkey * 13) % 90 AS STRING) END AS heart_rate,
 split_part('Sick,Cold,Tired,Cough,Under Treatment,Diarrhea,Fever,Dizzy,Vaccinated,Running Nose,Healthy', ',', CAST((c_custkey * 5) % 11 + 1 AS INT)) AS health_status,
 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE split_part('None,Aggression,Abortion,Sudden death,Blisters on mouth,Swollen udder,Fever,Cough,Sneezing,Vomiting', ',', CAST((c_custkey * 3) % 10 + 1 AS INT)) END AS symptom_1,
 CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE split_part('None,Salivation,Joint swelling,Bloody discharge,Drooling,Reduced milk yield,Mouth lesions,Nasal discharge,Ulcers in mouth,Diarrhea', ',', CAST((c_custkey * 7 + c_custkey % 3) % 10 + 1 AS INT)) END AS symptom_2,
 split_part('Rabies|Anthrax|PPR (Peste des petits ruminants)|FMD|Mastitis|Brucellosis|Newcastle Disease|Tick Fever', '|', CAST((c_custkey * 11) % 8 + 1 AS INT)) AS disease
FROM customer)"""

RECORD_UPDATES = """record_updates AS (
SELECT o_custkey AS animal_id, o_orderdate AS ts, o_orderkey AS seq,
 split_part('  Fever ,Cough,,Vomiting,Swollen udder', ',', CAST(o_orderkey % 5 + 1 AS INT)) AS symptom_1,
 split_part('Diarrhea,,Nasal discharge,Drooling', ',', CAST(o_orderkey % 4 + 1 AS INT)) AS symptom_2,
 concat('  ', o_orderpriority, ' ') AS suggestion,
 CASE WHEN o_orderstatus = 'F' THEN 'on' END AS special_care
FROM orders)"""

VACCINATIONS = """vaccinations AS (
SELECT user_id AS animal_id, ts, event_id AS seq,
 CASE WHEN event_id % 53 = 0 THEN '  ' ELSE split_part('FMD,HS,BQ,Anthrax,Tetanus,Rabies,Parvo,Distemper,Leptospirosis,Feline Panleukopenia', ',', CAST(event_id % 10 + 1 AS INT)) END AS vaccine,
 CAST(CAST(ts AS DATE) AS STRING) AS vaccine_date
FROM events)"""

SCANS = """scans AS (SELECT page_id AS scan_id,
 CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 5 = 0 THEN 'Animal #' || CAST(page_id + 90000000 AS VARCHAR)
      WHEN page_id % 7 = 0 THEN 'no number here' ELSE url END AS scanned_text FROM pages)"""

# Needs ANIMAL before it.
DIRTY = """dirty AS (
SELECT a.animal_id, c.copy_no,
 CASE WHEN a.animal_id % 29 = 0 THEN 'NaN' WHEN c.copy_no = 1 THEN name || ' copy' ELSE name END AS name,
 species, breed, sex,
 CASE WHEN a.animal_id % 13 = 0 THEN 'nan' WHEN a.animal_id % 11 = 0 THEN '0.0' ELSE age_years END AS age_years,
 CASE WHEN a.animal_id % 3 <> 0 THEN CAST(a.animal_id % 20 AS VARCHAR) END AS age,
 bp, CASE WHEN a.animal_id % 17 = 0 THEN '0' WHEN a.animal_id % 19 = 0 THEN 'NaN' ELSE heart_rate END AS heart_rate,
 CASE WHEN a.animal_id % 5 <> 0 THEN CAST(60 + a.animal_id % 50 AS VARCHAR) END AS heart_rate_bpm,
 CASE WHEN a.animal_id % 4 = 0 THEN 'nan' WHEN a.animal_id % 3 <> 0 THEN CAST(90 + a.animal_id % 10 AS VARCHAR) END AS oxygen_saturation_pct,
 CASE WHEN a.animal_id % 2 = 0 THEN '88' ELSE '' END AS oxygen_saturation,
 health_status, symptom_1, symptom_2, disease,
 CASE WHEN a.animal_id % 4 = 0 THEN 'nan' WHEN a.animal_id % 4 = 1 THEN 'Tick Fever' END AS detected_disease,
 CASE WHEN a.animal_id % 6 = 0 THEN 'Old (' || CAST(2000 + a.animal_id % 20 AS VARCHAR) || ')' END AS vaccination_1
FROM animal a JOIN (VALUES (0), (1)) c(copy_no) ON c.copy_no = 0 OR a.animal_id % 50 = 0)"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# Python str.strip() whitespace as a DuckDB expression.
WS = " || ".join(f"chr({ord(ch)})" for ch in FV.PY_WHITESPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sym(expr: str) -> str:
    """Request-side symptom text: lower(strip(x)), null -> ''."""
    return f"coalesce(lower({strip(expr)}), '')"


def shown(expr: str) -> str:
    """Display text: null or 'nan' in any case is ''."""
    return f"(CASE WHEN {expr} IS NULL OR lower({expr}) = 'nan' THEN '' ELSE {expr} END)"


def given(*exprs: str, zero_falls_through: bool = False) -> str:
    """The first alias that is given: not blank, not 'nan' (and not a zero)."""
    def one(e: str) -> str:
        t = shown(e)
        zero = f" OR TRY_CAST({t} AS DOUBLE) = 0" if zero_falls_through else ""
        return f"CASE WHEN {t} = ''{zero} THEN NULL ELSE {t} END"
    return "coalesce(" + ", ".join(map(one, exprs)) + ", '')"


def num(expr: str) -> str:
    """Guarded float parse (bad -> NULL)."""
    return (f"CASE WHEN regexp_matches(CAST({expr} AS VARCHAR), {q(FV.FLOAT_PATTERN)}) "
            f"THEN CAST(trim(CAST({expr} AS VARCHAR)) AS DOUBLE) END")


def intval(expr: str) -> str:
    return (f"CASE WHEN regexp_matches(CAST({expr} AS VARCHAR), {q(FV.INT_PATTERN)}) "
            f"THEN CAST(trim(CAST({expr} AS VARCHAR)) AS BIGINT) END")


def keyword_values(entries: Sequence[tuple[str, Sequence[str]]]) -> str:
    """VALUES (ord, disease, kw) rows."""
    rows = []
    for i, (label, kws) in enumerate(entries, start=1):
        for kw in kws:
            rows.append(f"({i}, {q(label)}, {q(kw)})")
    return "VALUES " + ", ".join(rows)


def pair_values(pairs: Sequence[tuple[str, str]]) -> str:
    """VALUES (ord, a, b) rows."""
    return "VALUES " + ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(pairs, 1))


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
