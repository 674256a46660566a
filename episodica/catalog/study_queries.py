"""Queries that run the study itself over the derived ward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.stats_queries import (
    ADJUSTED_PAIRS_SQL,
    chi2_tail_sql,
    chi_square_sql,
    km_sql,
    kruskal_sql,
    logrank_all_sql,
    logrank_pairs_sql,
    numeric_sql,
    pairwise_chisq_sql,
    pairwise_t_sql,
    rounded,
)
from episodica.catalog.ward import records_sql, ward_tables
from episodica.operators import hypothesis, summary
from episodica.plans import code_lists as fixed
from episodica.plans import study

FRAME = ("patientunitstayid", "sepsis_flag", "gender_trans", "age_trans", "apache_iv", "admissionheight",
         "admissionweight", "BMI", "ICU", "race", "antipyretic_flag", "icu_mortality", "hosp_mortality", "T_max",
         "T_class", "T_class_ordinal", "icu_los_hours", "hosp_los_days", "HR_max", "WBC_max")

CLEAN_SQL = f"""
    SELECT patientunitstayid, sepsis_flag, CASE gender WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS gender_trans,
           TRY_CAST(CASE WHEN age = '> 89' THEN '91.5' ELSE age END AS DOUBLE) AS age_trans,
           CASE WHEN apache_iv >= 0 THEN apache_iv END AS apache_iv,
           CASE WHEN admissionheight BETWEEN 50 AND 300 THEN admissionheight END AS admissionheight,
           CASE WHEN admissionweight BETWEEN 20 AND 600 THEN admissionweight END AS admissionweight,
           CASE WHEN unittype IN ('Cardiac ICU', 'CSICU', 'CTICU', 'CCU-CTICU') THEN 'Cardiac ICU' ELSE unittype END AS ICU,
           CASE WHEN coalesce(ethnicity, '') IN ('Native American', '') THEN 'Other/Unknown' ELSE ethnicity END AS race,
           CASE WHEN acetaminophen_flag = 1 OR nsaid_flag = 1 THEN 1 ELSE 0 END AS antipyretic_flag,
           icu_mortality, CASE WHEN icu_mortality = 1 THEN 1 ELSE hosp_mortality END AS hosp_mortality, T_max,
           CASE WHEN T_max < 36 THEN '< 36' WHEN T_max < 37.2 THEN '36 ~ 37.1' WHEN T_max < 38.3 THEN '37.2 ~ 38.2'
                WHEN T_max < 39 THEN '38.3 ~ 38.9' ELSE '>= 39' END AS T_class,
           CASE WHEN T_max < 36 THEN 1 WHEN T_max < 37.2 THEN 2 WHEN T_max < 38.3 THEN 3 WHEN T_max < 39 THEN 4
                ELSE 5 END AS T_class_ordinal,
           icu_los_hours, hosp_los_hours / 24 AS hosp_los_days, HR_max, WBC_max
    FROM records
    WHERE seqnum = 1 AND icu_los_hours >= 24 AND gender IS NOT NULL AND unitvisitnumber = 1
      AND TRY_CAST(CASE WHEN age = '> 89' THEN '91.5' ELSE age END AS DOUBLE) >= 18
"""
BMI_SQL = """
    SELECT *, CASE WHEN admissionweight / pow(admissionheight / 100, 2) BETWEEN 15 AND 100
                   THEN admissionweight / pow(admissionheight / 100, 2) END AS BMI
"""
FRAMES_SQL = records_sql() + f", everyone AS MATERIALIZED ({BMI_SQL} FROM ({CLEAN_SQL}))"
EXACT = [c for c in FRAME if c not in ("BMI", "hosp_los_days")]


_built: dict[tuple[str, str], study.Frames] = {}


def _frames(s: Sample) -> study.Frames:
    """The analysis frames, built once for a session and a folder of sample tables: their records are kept by a checkpoint."""
    key = s.spark.sparkContext.applicationId, s.sf_dir
    if key not in _built:
        _built[key] = study.frames(ward_tables(s, by_stay=True))
    return _built[key]


@register("study_frame", FRAMES_SQL + f"""
    SELECT {', '.join(EXACT)}, round(BMI, 6) AS BMI, round(hosp_los_days, 6) AS hosp_los_days FROM everyone
""")
def study_frame(s: Sample) -> DataFrame:
    everyone = _frames(s).everyone
    return rounded(everyone.select(*FRAME), "BMI", "hosp_los_days")


TABLE_VARIABLES = ("age_trans", "BMI", "apache_iv", "HR_max", "T_max", "WBC_max")


@register("study_table_1", FRAMES_SQL + " UNION ALL ".join(
    numeric_sql(v, "everyone", "sepsis_flag") for v in TABLE_VARIABLES
))
def study_table_1(s: Sample) -> DataFrame:
    everyone = _frames(s).everyone
    out = summary.numeric_table(everyone, "sepsis_flag", TABLE_VARIABLES)
    return rounded(out, "mean", "sd", "q1", "median", "q3", digits=4)


@register("study_table_1_tests")
def study_table_1_tests(s: Sample) -> DataFrame:
    numeric, categorical = study.table_1(_frames(s))
    columns = ["label", "stratum", "statistic", "df", "p"]
    out = numeric.select(F.lit("").alias("level"), *columns).unionByName(categorical.select("level", *columns))
    return rounded(out, "statistic", "p")


SEPSIS_SQL = "(SELECT * FROM everyone WHERE sepsis_flag = 1)"


@register("study_table_2_kruskal", FRAMES_SQL + " UNION ALL ".join(
    f"({kruskal_sql(v, SEPSIS_SQL, 'T_class')})" for v in ("age_trans", "apache_iv", "HR_max", "icu_los_hours")
))
def study_table_2_kruskal(s: Sample) -> DataFrame:
    sepsis = _frames(s).sepsis
    out = hypothesis.kruskal(sepsis, "T_class", ["age_trans", "apache_iv", "HR_max", "icu_los_hours"])
    return rounded(out, "statistic", "p")


REGION_SQL = """SELECT CASE race WHEN 'Hispanic' THEN 'Yes-Region' ELSE 'Non-Region' END AS race1, sepsis_flag
                FROM everyone WHERE race IN ('Other/Unknown', 'African American', 'Asian', 'Caucasian', 'Hispanic')"""


@register("study_region_test", FRAMES_SQL + chi_square_sql(REGION_SQL, "race1", "sepsis_flag").replace("WITH c AS", ", c AS") + f"""
    SELECT 'race1 x sepsis_flag' AS test, round(corrected, 6) AS statistic, CAST(1 AS INTEGER) AS df,
           CAST(total AS BIGINT) AS total, round({chi2_tail_sql('corrected', '1')}, 6) AS p FROM s
""")
def study_region_test(s: Sample) -> DataFrame:
    return rounded(study.region_test(_frames(s)), "statistic", "p")


@register("study_survival", FRAMES_SQL + km_sql("""
    SELECT T_class AS grp, hosp_los_days AS days, hosp_mortality AS outcome FROM everyone
    WHERE sepsis_flag = 0 AND hosp_mortality IS NOT NULL
"""))
def study_survival(s: Sample) -> DataFrame:
    return rounded(study.survival_curves(_frames(s).nonsepsis), "survival_pct")


SEPSIS_FOLLOW_UP = """
    SELECT T_class AS grp, hosp_los_days AS days, hosp_mortality AS outcome FROM everyone
    WHERE sepsis_flag = 1 AND hosp_mortality IS NOT NULL
"""


@register("study_survival_pairs", FRAMES_SQL + "," + logrank_pairs_sql(SEPSIS_FOLLOW_UP) + ADJUSTED_PAIRS_SQL)
def study_survival_pairs(s: Sample) -> DataFrame:
    out = study.survival_pairs(_frames(s).sepsis).where("statistic IS NOT NULL")
    ordered = {"level_a": F.least("level_a", "level_b"), "level_b": F.greatest("level_a", "level_b")}
    return rounded(out.withColumns(ordered), "statistic", "p", "p_adjusted")


@register("study_survival_test", FRAMES_SQL + "," + logrank_all_sql(f"({SEPSIS_FOLLOW_UP})", 5))
def study_survival_test(s: Sample) -> DataFrame:
    return rounded(study.survival_test(_frames(s).sepsis), "statistic", "p")


NONSEPSIS_SQL = "SELECT * FROM everyone WHERE sepsis_flag = 0"


@register("study_stay_length_pairs", FRAMES_SQL + "," + pairwise_t_sql(NONSEPSIS_SQL, "icu_los_hours", "T_class"))
def study_stay_length_pairs(s: Sample) -> DataFrame:
    out = study.stay_length_pairs(_frames(s).nonsepsis)
    return rounded(out, "statistic", "p", "p_adjusted")


@register("study_mortality_pairs", FRAMES_SQL + "," + pairwise_chisq_sql(NONSEPSIS_SQL, "icu_mortality", "T_class"))
def study_mortality_pairs(s: Sample) -> DataFrame:
    out = study.mortality_pairs(_frames(s).nonsepsis)
    return rounded(out, "statistic", "p", "p_adjusted")


@register("study_mortality_model")
def study_mortality_model(s: Sample) -> DataFrame:
    fit = study.mortality_model(_frames(s).sepsis)
    return rounded(fit.odds_ratios(), "odds_ratio", "low_95", "high_95", digits=5)


@register("study_matched_table")
def study_matched_table(s: Sample) -> DataFrame:
    _, matched = study.antipyretic_matching(_frames(s).nonsepsis)
    numeric, _ = study.matched_table(matched)
    return rounded(numeric.drop("label"), "mean", "sd", "q1", "median", "q3", "statistic", "p", digits=4)
