"""Cleaning of analysis frames: one pure, narrow transformation, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.columns import (
    bin_ordinal,
    either_flag,
    keep_range,
    left_closed_bin,
    mass_index,
    member,
    merge_levels,
    numeric_text,
    override_where,
)
from episodica.operators.factors import as_factor
from episodica.plans import code_lists as fixed


def clean(df: DataFrame) -> DataFrame:
    """Labels, plausibility limits, merged levels and derived columns of cohort records."""
    ranged = df.withColumns({
        "gender_trans": F.when(F.col("gender") == 0, "Female").when(F.col("gender") == 1, "Male"),
        "age_trans": numeric_text("age", fixed.TOP_CODED_AGE),
        "apache_iv": keep_range("apache_iv", low=0),
        "admissionheight": keep_range("admissionheight", *fixed.HEIGHT_CM),
        "admissionweight": keep_range("admissionweight", *fixed.WEIGHT_KG),
        "ICU": merge_levels("unittype", fixed.CARDIAC_UNITS, fixed.CARDIAC_UNIT),
        # an unknown ethnicity is exported as a blank, which is a member of the merged level
        "race": merge_levels(F.coalesce("ethnicity", F.lit("")), fixed.OTHER_ETHNICITY_MEMBERS, fixed.OTHER_ETHNICITY),
        "antipyretic_flag": either_flag("acetaminophen_flag", "nsaid_flag"),
        "hosp_mortality": override_where("hosp_mortality", F.col("icu_mortality") == 1, 1).cast("int"),
        "T_class": left_closed_bin("T_max", fixed.TEMPERATURE_BREAKS, fixed.TEMPERATURE_CLASSES),
        "T_class_ordinal": bin_ordinal("T_max", fixed.TEMPERATURE_BREAKS),
        "hosp_los_days": F.col("hosp_los_hours") / F.lit(24.0),
    })
    ordered = as_factor(as_factor(ranged, "T_class", fixed.TEMPERATURE_CLASSES), "gender_trans", fixed.SEXES)
    derived = ordered.withColumn(
        "BMI", keep_range(mass_index("admissionweight", "admissionheight"), *fixed.BMI_RANGE)
    )
    return derived.na.drop(subset=["gender_trans", "age_trans"])


def adult_first_visits(df: DataFrame, age: str = "age_trans", visit: str = "unitvisitnumber") -> DataFrame:
    return df.where((F.col(age) >= fixed.ADULT_AGE) & (F.col(visit) == 1))


def stack_cohorts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both cohorts by column name, with the two-level ethnicity column."""
    return first.unionByName(second).withColumn(
        "race1",
        F.when(member("race", fixed.NON_REGION_ETHNICITY), "Non-Region")
        .when(member("race", fixed.REGION_ETHNICITY), "Yes-Region"),
    )


def fever_subset(df: DataFrame) -> DataFrame:
    """The two warmest classes with a known score."""
    return df.where(member("T_class", fixed.FEVER_CLASSES) & F.col("apache_iv").isNotNull())
