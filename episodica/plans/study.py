"""The temperature study: from cohort records to tables, models and survival."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from episodica.operators import hypothesis, summary, survival
from episodica.operators.clean import adult_first_visits, clean, fever_subset, stack_cohorts
from episodica.operators.matching import match_nearest, matched_rows
from episodica.operators.models import Design, LogisticFit, fit_logistic, propensity_score
from episodica.plans import code_lists as fixed
from episodica.plans.cohort import STAY, assemble, select_cohort
from episodica.sources.stages import StageStore
from episodica.sources.tables import checkpointed, write_dataset

# --- fixed values: variables of the study's tables and models ----------------
TABLE_1 = (
    ("age_trans", "BMI", "apache_iv", "HR_max", "RR_max", "SpO2_min", "MAP_min", "T_max", "WBC_max", "LAC_max",
     "NLR_max", "uo_24h"),
    ("gender_trans", "ICU", "race", "region", "hypertension_flag", "diabetes_flag", "CKD_flag", "COPD_flag",
     "heartfailure_flag", "cancer_flag", "ventilation_flag", "dialysis_flag", "vasopressor_flag"),
)
TABLE_2 = (
    ("age_trans", "BMI", "apache_iv", "sofa", "HR_max", "RR_max", "SpO2_min", "MAP_min", "WBC_max", "LAC_max",
     "NLR_max", "hosp_los_hours", "icu_los_hours"),
    ("gender_trans", "acetaminophen_flag", "nsaid_flag", "icu_mortality", "hosp_mortality"),
)
TABLE_4 = (
    ("age_trans", "BMI", "apache_iv", "hosp_los_hours", "icu_los_hours", "HR_max", "RR_max", "SpO2_min", "MAP_min",
     "T_max", "WBC_max", "LAC_max", "NLR_max", "uo_24h"),
    ("gender_trans", "icu_mortality", "hosp_mortality", "ventilation_flag", "dialysis_flag", "vasopressor_flag"),
)
OUTCOME_MODEL = Design(
    numeric=("age_trans", "BMI", "apache_iv"),
    factors={"T_class": (fixed.TEMPERATURE_CLASSES, fixed.REFERENCE_CLASS), "gender_trans": (fixed.SEXES, "Female")},
)
TREATMENT_MODEL = Design(numeric=("age_trans", "apache_iv"), factors={"gender_trans": (fixed.SEXES, "Female")})


@dataclass(frozen=True)
class Frames:
    """The analysis frames of both cohorts."""

    sepsis: DataFrame
    nonsepsis: DataFrame

    @property
    def everyone(self) -> DataFrame:
        return stack_cohorts(self.sepsis, self.nonsepsis)


def frames(t: Mapping[str, DataFrame], workdir: str | None = None, store: StageStore | None = None, inputs: str = "") -> Frames:
    """Builds the records once, keeps them in files, and derives both frames from there.

    With a ``store`` the records and their parts are stages made from ``inputs``, which later sessions find again.
    """
    if store is not None:
        kept = store.keep("records", inputs, lambda: assemble(t, first_only=True, store=store, inputs=inputs), STAY)
    else:
        records = assemble(t, first_only=True)
        kept = write_dataset(records, f"{workdir}/records") if workdir else checkpointed(records)
    return Frames(*(adult_first_visits(clean(select_cohort(kept, sepsis))) for sepsis in (True, False)))


def table_1(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Baseline of both cohorts."""
    return summary.baseline_table(f.everyone, "sepsis_flag", *TABLE_1, labels=fixed.DISPLAY_LABELS)


def region_test(f: Frames) -> DataFrame:
    """Two-level ethnicity against cohort."""
    return hypothesis.independence(f.everyone, "race1", "sepsis_flag")


def temperature_table(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline and outcomes by temperature class."""
    return summary.baseline_table(frame, "T_class", *TABLE_2, labels=fixed.DISPLAY_LABELS)


def stay_length_pairs(frame: DataFrame) -> DataFrame:
    return hypothesis.pairwise_t(frame, "icu_los_hours", "T_class")


def mortality_pairs(frame: DataFrame) -> DataFrame:
    return hypothesis.pairwise_chi_square(frame, "T_class", "icu_mortality")


def normality(frame: DataFrame, variable: str) -> DataFrame:
    return hypothesis.qq_points(frame, [variable])


def mortality_model(frame: DataFrame) -> LogisticFit:
    """Hospital mortality by temperature class, adjusted for age, sex, BMI and score."""
    return fit_logistic(frame, "hosp_mortality", OUTCOME_MODEL)


def antipyretic_matching(nonsepsis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched pairs among feverish patients, and the rows of both sides."""
    scored = checkpointed(
        propensity_score(fever_subset(nonsepsis), "antipyretic_flag", TREATMENT_MODEL)
    )
    pairs = match_nearest(scored, STAY, "antipyretic_flag")
    return pairs, matched_rows(scored, pairs, STAY)


def matched_table(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    return summary.baseline_table(matched, "antipyretic_flag", *TABLE_4, labels=fixed.DISPLAY_LABELS)


def survival_curves(frame: DataFrame) -> DataFrame:
    return survival.km_curve(frame, "hosp_los_days", "hosp_mortality", "T_class")


def survival_risk_table(frame: DataFrame) -> DataFrame:
    return survival.risk_table(frame, "hosp_los_days", "hosp_mortality", "T_class", fixed.RISK_TABLE_DAYS)


def survival_test(frame: DataFrame) -> DataFrame:
    """Log-rank test over all follow-up; the 28-day limit is one of display."""
    return survival.logrank_test(frame, "hosp_los_days", "hosp_mortality", "T_class", fixed.TEMPERATURE_CLASSES)


def survival_pairs(frame: DataFrame) -> DataFrame:
    return survival.pairwise_logrank(frame, "hosp_los_days", "hosp_mortality", "T_class", fixed.TEMPERATURE_CLASSES)
