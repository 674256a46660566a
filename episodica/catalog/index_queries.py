"""Queries for large rule sets and for ordered factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.views import CODED_SQL, STAYS_SQL, coded, stays
from episodica.operators.factors import as_factor, with_level_order
from episodica.operators.code_index import raised_flags
from episodica.operators.rules import CodeRule
from episodica.operators.summary import categorical_table

TYPES = ("PROMO", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD")
COLOURS = ("red", "blue", "hot", "cold", "old")


def _rules() -> list[CodeRule]:
    """A rule per type and brand (brand 1 begins brands 10 to 19 as well) and per type and colour, and some with other shapes."""
    out = [CodeRule(f"{t} {n}", prefixes=(f"{t}|Brand#{n}",)) for t in TYPES for n in range(1, 26)]
    out += [CodeRule(f"{t} {c}", patterns=(f"{t}|%|{c}%",)) for t in TYPES for c in COLOURS]
    out += [CodeRule(f"not {n}", prefixes=("PROMO|",), veto=(f"PROMO|Brand#{n}",)) for n in range(1, 26)]
    out += [CodeRule("rod", patterns=("%rod",)), CodeRule("inner", patterns=("%|Brand#_|%",)), CodeRule("mixed", patterns=("%|Brand#7|%", "LARGE|%bolt")),
            CodeRule("exact", exact=("PROMO|Brand#7|hot rod", "SMALL|Brand#2|red bolt"))]
    return out


def _rules_sql() -> str:
    rows = []
    for r in _rules():
        likes = [(p + "%", False) for p in r.prefixes] + [(p, False) for p in (*r.patterns, *r.exact)] + [(p + "%", True) for p in r.veto]
        rows += [f"('{r.flag}', '{p}', {str(veto).lower()})" for p, veto in likes]
    return ", ".join(rows)


@register("code_index_flags", f"""
    WITH r(flag, pattern, veto) AS (VALUES {_rules_sql()}), e AS (SELECT DISTINCT stay, code FROM ({CODED_SQL})),
    hit AS (SELECT d.code, r.flag FROM (SELECT DISTINCT code FROM e) d JOIN r ON d.code LIKE r.pattern GROUP BY d.code, r.flag HAVING NOT bool_or(r.veto))
    SELECT flag, count(DISTINCT stay) AS n_stays FROM e JOIN hit USING (code) GROUP BY flag
""")
def code_index_flags(s: Sample) -> DataFrame:
    return raised_flags(coded(s), "stay", "code", _rules()).groupBy("flag").agg(F.count(F.lit(1)).alias("n_stays"))


LEVELS = ("5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH")
LABELS = {"5-LOW": "Low", "1-URGENT": "Urgent"}


@register("factor_table", f"""
    WITH b AS (SELECT status, CASE WHEN grp <> '4-NOT SPECIFIED' THEN grp END AS level FROM ({STAYS_SQL})),
    t AS (SELECT * FROM b UNION ALL SELECT 'Total', level FROM b),
    l(level, ordinal, level_label) AS (VALUES ('5-LOW', 1, 'Low'), ('3-MEDIUM', 2, '3-MEDIUM'), ('1-URGENT', 3, 'Urgent'), ('2-HIGH', 4, '2-HIGH'))
    SELECT 'grp' AS variable, l.level, l.ordinal, l.level_label, t.status AS stratum, count(*) FILTER (t.level = l.level) AS n,
           count(*) FILTER (t.level IS NULL) AS missing
    FROM t CROSS JOIN l GROUP BY l.level, l.ordinal, l.level_label, t.status
""")
def factor_table(s: Sample) -> DataFrame:
    frame = as_factor(stays(s), "grp", LEVELS, LABELS)
    table = with_level_order(categorical_table(frame, "status", ["grp"]), frame)
    return table.select("variable", "level", "ordinal", "level_label", "stratum", "n", "missing").orderBy("variable", "ordinal", "stratum")
