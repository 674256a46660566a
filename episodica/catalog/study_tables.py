"""The study's whole output over the derived ward: baseline tables with tests, both models, and survival of both cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.stats_queries import (
    ADJUSTED_PAIRS_SQL,
    chi2_tail_sql,
    km_sql,
    kruskal_sql,
    logrank_pairs_sql,
    numeric_sql,
    rounded,
)
from episodica.catalog.study_queries import FRAMES_SQL, SEPSIS_FOLLOW_UP, _frames
from episodica.functions.normal import normal_quantile_sql
from episodica.plans import code_lists as fixed
from episodica.plans import study

#: Columns of the records that the cleaning leaves as they are.
PLAIN = ("RR_max", "SpO2_min", "MAP_min", "LAC_max", "NLR_max", "uo_24h", "region", "hypertension_flag", "diabetes_flag", "CKD_flag", "COPD_flag",
         "heartfailure_flag", "cancer_flag", "ventilation_flag", "dialysis_flag", "vasopressor_flag", "sofa", "hosp_los_hours",
         "acetaminophen_flag", "nsaid_flag")
WHOLE_SQL = FRAMES_SQL + f""", whole AS MATERIALIZED (
    SELECT e.*, {', '.join(f'r.{c}' for c in PLAIN)} FROM everyone e
    JOIN (SELECT * FROM records WHERE seqnum = 1) r ON r.patientunitstayid = e.patientunitstayid)"""


def _label_sql(column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in fixed.DISPLAY_LABELS.items())
    return f"CASE {column} {cases} ELSE {column} END"


def numeric_half_sql(base: str, stratum: str, variables: Sequence[str]) -> str:
    values = " UNION ALL ".join(numeric_sql(v, base, stratum) for v in variables)
    tests = " UNION ALL ".join(f"({kruskal_sql(v, base, stratum)})" for v in variables)
    return f"""{WHOLE_SQL}, v AS ({values}), t AS ({tests})
    SELECT v.*, t.statistic, t.df, t.p, {_label_sql('v.variable')} AS label FROM v LEFT JOIN t ON t.variable = v.variable AND t.df >= 0
    """


def categorical_half_sql(base: str, stratum: str, variables: Sequence[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, CAST({stratum} AS VARCHAR) AS grp, CAST({v} AS VARCHAR) AS level FROM ({base}) WHERE {stratum} IS NOT NULL" for v in variables)
    return f"""{WHOLE_SQL}, b AS MATERIALIZED ({rows}),
    t AS (SELECT * FROM b UNION ALL SELECT variable, 'Total', level FROM b),
    cells AS (SELECT * FROM (SELECT DISTINCT variable, grp FROM t) JOIN (SELECT DISTINCT variable, level FROM t WHERE level IS NOT NULL) USING (variable)),
    o AS (SELECT c.variable, c.grp, c.level, count(b.level) AS o FROM cells c LEFT JOIN b ON b.variable = c.variable AND b.grp = c.grp AND b.level = c.level
          WHERE c.grp <> 'Total' GROUP BY 1, 2, 3),
    e AS (SELECT *, sum(o) OVER (PARTITION BY variable, grp) * 1.0 * sum(o) OVER (PARTITION BY variable, level) / sum(o) OVER (PARTITION BY variable) AS x FROM o),
    s AS (SELECT variable, sum((o - x) * (o - x) / x) AS statistic, count(DISTINCT grp) FILTER (x > 0) AS nr, count(DISTINCT level) FILTER (x > 0) AS nk
          FROM e WHERE x > 0 GROUP BY 1),
    p AS (SELECT variable, statistic, CAST((nr - 1) * (nk - 1) AS INTEGER) AS df FROM s)
    SELECT c.variable, c.level, c.grp AS stratum, count(*) FILTER (t.level = c.level) AS n,
           round(count(*) FILTER (t.level = c.level) * 100.0 / nullif(count(t.level), 0), 6) AS pct, count(*) FILTER (t.level IS NULL) AS missing,
           round(max(p.statistic), 6) AS statistic, max(p.df) AS df, round(max({chi2_tail_sql('p.statistic', 'p.df')}), 6) AS p, {_label_sql('c.variable')} AS label
    FROM cells c JOIN t ON t.variable = c.variable AND t.grp = c.grp LEFT JOIN p ON p.variable = c.variable GROUP BY 1, 2, 3
    """


def _numeric(half: DataFrame) -> DataFrame:
    return rounded(rounded(half, "mean", "sd", "q1", "median", "q3", digits=4), "statistic", "p")


def _categorical(half: DataFrame) -> DataFrame:
    return rounded(half, "pct", "statistic", "p")


ALL_SQL = "SELECT * FROM whole"
SEPSIS_ROWS, OTHER_ROWS = ("SELECT * FROM whole WHERE sepsis_flag = 1", "SELECT * FROM whole WHERE sepsis_flag = 0")


# --- baseline of both cohorts -------------------------------------------------
@register("study_table_1_numeric", numeric_half_sql(ALL_SQL, "sepsis_flag", study.TABLE_1[0]))
def study_table_1_numeric(s: Sample) -> DataFrame:
    return _numeric(study.table_1(_frames(s))[0])


@register("study_table_1_categorical", categorical_half_sql(ALL_SQL, "sepsis_flag", study.TABLE_1[1]))
def study_table_1_categorical(s: Sample) -> DataFrame:
    return _categorical(study.table_1(_frames(s))[1])


# --- by temperature class -----------------------------------------------------
@register("study_table_2_numeric", numeric_half_sql(SEPSIS_ROWS, "T_class", study.TABLE_2[0]))
def study_table_2_numeric(s: Sample) -> DataFrame:
    return _numeric(study.temperature_table(_frames(s).sepsis)[0])


@register("study_table_2_categorical", categorical_half_sql(SEPSIS_ROWS, "T_class", study.TABLE_2[1]))
def study_table_2_categorical(s: Sample) -> DataFrame:
    return _categorical(study.temperature_table(_frames(s).sepsis)[1])


# without sepsis there is no score of organ dysfunction, so its row has counts only
@register("study_table_3_numeric", numeric_half_sql(OTHER_ROWS, "T_class", study.TABLE_2[0]))
def study_table_3_numeric(s: Sample) -> DataFrame:
    return _numeric(study.temperature_table(_frames(s).nonsepsis)[0])


@register("study_table_3_categorical", categorical_half_sql(OTHER_ROWS, "T_class", study.TABLE_2[1]))
def study_table_3_categorical(s: Sample) -> DataFrame:
    return _categorical(study.temperature_table(_frames(s).nonsepsis)[1])


@register("study_matched_categorical")
def study_matched_categorical(s: Sample) -> DataFrame:
    return _categorical(study.matched_table(study.antipyretic_matching(_frames(s).nonsepsis)[1])[1])


# --- normality ----------------------------------------------------------------
def qq_sql(base: str, variable: str) -> str:
    return f"""
    {base}, r AS (SELECT {variable} AS v, row_number() OVER (ORDER BY {variable}) AS i, count(*) OVER () AS n
        FROM everyone WHERE sepsis_flag = 1 AND {variable} IS NOT NULL),
    p AS (SELECT v AS sample, CAST(i AS BIGINT) AS rank, (i - CASE WHEN n > 10 THEN 0.5 ELSE 0.375 END) / (n + 1 - 2 * CASE WHEN n > 10 THEN 0.5 ELSE 0.375 END) AS share FROM r)
    SELECT '{variable}' AS variable, rank, round(share, 9) AS share, CAST(sample AS DOUBLE) AS sample, round({normal_quantile_sql('share')}, 6) AS theoretical FROM p
    """


def _qq(s: Sample, variable: str) -> DataFrame:
    return rounded(rounded(study.normality(_frames(s).sepsis, variable), "theoretical"), "share", digits=9)


@register("study_qq_temperature", qq_sql(FRAMES_SQL, "T_max"))
def study_qq_temperature(s: Sample) -> DataFrame:
    return _qq(s, "T_max")


@register("study_qq_stay", qq_sql(FRAMES_SQL, "icu_los_hours"))
def study_qq_stay(s: Sample) -> DataFrame:
    return _qq(s, "icu_los_hours")


# --- models -------------------------------------------------------------------
@register("study_mortality_model_nonsepsis")
def study_mortality_model_nonsepsis(s: Sample) -> DataFrame:
    fit = study.mortality_model(_frames(s).nonsepsis)
    out = fit.odds_ratios().join(fit.coefficients(), "term")
    return rounded(out, *[c for c in out.columns if c != "term"], digits=5)


@register("study_model_statistics")
def study_model_statistics(s: Sample) -> DataFrame:
    parts = []
    for name, frame in (("sepsis", _frames(s).sepsis), ("nonsepsis", _frames(s).nonsepsis)):
        found = study.mortality_model(frame).statistics(frame, "hosp_mortality")
        parts.append(found.select(F.lit(name).alias("cohort"), "*"))
    return rounded(parts[0].unionByName(parts[1]), "deviance", "null_deviance", "aic", digits=4)


# --- survival -----------------------------------------------------------------
OTHER_FOLLOW_UP = SEPSIS_FOLLOW_UP.replace("sepsis_flag = 1", "sepsis_flag = 0")


@register("study_survival_sepsis", FRAMES_SQL + km_sql(SEPSIS_FOLLOW_UP))
def study_survival_sepsis(s: Sample) -> DataFrame:
    return rounded(study.survival_curves(_frames(s).sepsis), "survival_pct")


@register("study_survival_pairs_nonsepsis", FRAMES_SQL + "," + logrank_pairs_sql(OTHER_FOLLOW_UP) + ADJUSTED_PAIRS_SQL)
def study_survival_pairs_nonsepsis(s: Sample) -> DataFrame:
    out = study.survival_pairs(_frames(s).nonsepsis).where("statistic IS NOT NULL")
    ordered = {"level_a": F.least("level_a", "level_b"), "level_b": F.greatest("level_a", "level_b")}
    return rounded(out.withColumns(ordered), "statistic", "p", "p_adjusted")


def risk_sql(base: str) -> str:
    grid = ", ".join(f"({x})" for x in fixed.RISK_TABLE_DAYS)
    return f"""{FRAMES_SQL}
    SELECT f.grp AS "group", CAST(g.x AS DOUBLE) AS time, CAST(sum(CASE WHEN f.days >= g.x THEN 1 ELSE 0 END) AS BIGINT) AS n_risk
    FROM ({base}) f CROSS JOIN (VALUES {grid}) g(x) WHERE f.grp IS NOT NULL AND f.days IS NOT NULL GROUP BY 1, 2
    """


@register("study_risk_sepsis", risk_sql(SEPSIS_FOLLOW_UP))
def study_risk_sepsis(s: Sample) -> DataFrame:
    return study.survival_risk_table(_frames(s).sepsis)


@register("study_risk_nonsepsis", risk_sql(OTHER_FOLLOW_UP))
def study_risk_nonsepsis(s: Sample) -> DataFrame:
    return study.survival_risk_table(_frames(s).nonsepsis)
