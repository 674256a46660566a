"""The ICU cohort: one 84-column record per person.

Every source table is read once and reduced to one row per stay before any join, and all per-stay frames are partitioned by the stay key.
Vital signs are first reduced to partial states per stay and temperature site, which get their sites from the mapping and are merged by
stay. First stays are chosen on narrow rows before the wide joins, so those carry selected stays only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.columns import (
    MINUTES_PER_DAY,
    MINUTES_PER_HOUR,
    present,
    sex_code,
    vital_status,
    whole_hours,
)
from episodica.operators.episodes import bounded, lookup, number_episodes, qualifying_keys
from episodica.operators.rules import CodeRule, event_flags, flags_for_all, mask_flag, rule_mask
from episodica.operators.windows import (
    AGGREGATES,
    extreme_ratio,
    in_window,
    merge_series,
    merged_extremes,
    pivot_extremes,
    ratio_of_extremes,
    summarise_window,
    tag_choices,
    tagged_extremes,
)
from episodica.plans import code_lists as fixed
from episodica.sources.stages import StageStore

Tables = Mapping[str, DataFrame]

STAY = "patientunitstayid"
PERSON = "uniquepid"
DAY_1 = (0, MINUTES_PER_DAY)
WEEK_1 = (0, 7 * MINUTES_PER_DAY)
AROUND_ADMISSION = (-MINUTES_PER_DAY, MINUTES_PER_DAY)
EXPOSURE_WINDOW = (-6 * MINUTES_PER_HOUR, 30 * MINUTES_PER_HOUR)

COMORBIDITIES = tuple(r.flag for r in fixed.DIAGNOSIS_RULES)
INTERVENTIONS = tuple(r.flag for r in fixed.TREATMENT_RULES)
NO_BREAK = "\u00a0"
EXPOSURES = ("acetaminophen_flag", "nsaid_flag", "cooling_flag")

COHORT_COLUMNS = (
    "uniquepid", "patienthealthsystemstayid", "patientunitstayid", "unitvisitnumber", "hospitalid",
    "region", "unittype", "hospitaladmitoffset", "hospitaldischargeoffset", "unitdischargeoffset",
    "apache_iv", "hospitaldischargeyear", "age", "apacheadmissiondx", "apachedxgroup",
    "hosp_mortality", "icu_mortality", "gender", "ethnicity", "admissionheight", "admissionweight",
    "icu_los_hours", "hosp_los_hours", "sofa", "sepsis_flag",
    *(c for c in COMORBIDITIES if c != "exclusion_flag"), *INTERVENTIONS,
    "WBC_max", "HGB_min", "HCT_min", "PLT_min", "LAC_max", "ALT_max", "AST_max", "BIL_max", "BUN_max",
    "SCR_max", "NLR_max", "uo_24h", "OI_min", "CO_min", "CI_min", "SVO2_min", "SVR_max", "SVRI_max",
    "HR_max", "HR_avg", "RR_max", "RR_avg", "SpO2_min", "SpO2_avg", "MAP_min", "MAP_avg",
    "T_max", "T_min", "T_max_peri", "tmax_peri", "T_min_peri", "tmin_peri", "t_peri_flag",
    "T_max_core", "tmax_core", "T_min_core", "tmin_core", "t_core_flag", *EXPOSURES, "seqnum",
)


def positive_cultures(t: Tables) -> DataFrame:
    """Cultures with an organism, taken within a day of admission."""
    organism = F.col("organism")
    return (
        in_window(t["microlab"], "culturetakenoffset", AROUND_ADMISSION)
        .where(organism.isNotNull() & (organism != fixed.NO_GROWTH))
        .select(STAY, "organism")
    )


def infection_cohort(t: Tables) -> DataFrame:
    """Stays with a listed infection diagnosis around admission and organ dysfunction.

    A stay with a positive culture but no listed diagnosis does not qualify, so
    cultures add nothing to the result and are not read here.
    """
    return qualifying_keys(
        in_window(t["diagnosis"], "diagnosisoffset", AROUND_ADMISSION),
        t["infection_diagnosis"], t["sofascore"], STAY, "diagnosisstring", "sofatotal", fixed.MIN_SOFA,
    ).withColumnRenamed("sofatotal", "sofa")


def diagnosed(t: Tables) -> DataFrame:
    """Comorbidity flags per stay, and ``infected``: a listed infection diagnosis around admission.

    With a small infection list this is one pass over the diagnoses; a large one is matched in a pass of its own.
    """
    codes = t["infection_diagnosis"].select("diagnosisstring").distinct()
    few, rules = bounded(codes.withColumn("_listed", F.lit(1))), fixed.DIAGNOSIS_RULES
    near = F.col("diagnosisoffset").between(*AROUND_ADMISSION)
    if few is None:
        listed = t["diagnosis"].where(near).select(STAY, "diagnosisstring").distinct().join(codes, "diagnosisstring", "left_semi")
        infected = listed.groupBy(STAY).agg(F.lit(1).alias("infected"))
        return event_flags(t["diagnosis"], STAY, "diagnosisstring", rules).join(infected, STAY, "left")
    masks = t["diagnosis"].join(few, "diagnosisstring", "left").select(
        STAY, rule_mask("diagnosisstring", rules).alias("_mask"), F.when(near, F.col("_listed")).alias("_near"))
    masks = masks.groupBy(STAY).agg(F.bit_or("_mask").alias("_mask"), F.max("_near").alias("infected"))
    return masks.select(STAY, *[mask_flag("_mask", i).alias(r.flag) for i, r in enumerate(rules)], "infected")


def hospitals(t: Tables) -> DataFrame:
    """One row per hospital; a repeated one is an error, as it would repeat records."""
    once = t["hospital"].groupBy("hospitalid").agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in t["hospital"].columns if c != "hospitalid"])
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("hospital rows are not unique by hospitalid"))).otherwise(F.col("region"))
    return once.select("hospitalid", checked.alias("region"))


def comorbidities(t: Tables) -> DataFrame:
    flags = event_flags(t["diagnosis"], STAY, "diagnosisstring", fixed.DIAGNOSIS_RULES)
    return flags_for_all(t["patient"], flags, STAY, COMORBIDITIES)


def _flag_any(condition: Column, name: str) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).alias(name)


TREATMENT_EXPOSURES = (
    CodeRule("acetaminophen_tx", exact=fixed.ACETAMINOPHEN_TREATMENTS),
    CodeRule("nsaid_tx", exact=fixed.NSAID_TREATMENTS),
    CodeRule("cooling_tx", exact=fixed.COOLING_TREATMENTS),
)


def treatment_flags(t: Tables) -> DataFrame:
    """Interventions (any time) and treatment-coded exposures (windowed), in one pass."""
    rules = (*fixed.TREATMENT_RULES, *TREATMENT_EXPOSURES)
    near = F.col("treatmentoffset").between(*EXPOSURE_WINDOW)
    exposures = rule_mask("treatmentstring", TREATMENT_EXPOSURES, len(fixed.TREATMENT_RULES))
    mask = rule_mask("treatmentstring", fixed.TREATMENT_RULES).bitwiseOR(F.when(near, exposures).otherwise(F.lit(0)))
    masks = t["treatment"].select(STAY, mask.alias("_mask")).groupBy(STAY).agg(F.bit_or("_mask").alias("_mask"))
    return masks.select(STAY, *[mask_flag("_mask", i).alias(r.flag) for i, r in enumerate(rules)])


def _listed(c: str, texts: tuple[str, ...], faithful: bool) -> Column:
    """Membership in a list of texts; unless ``faithful``, no-break and plain spaces are the same on both sides."""
    if faithful:
        return F.col(c).isin(*texts)
    return F.translate(c, NO_BREAK, " ").isin(*[x.replace(NO_BREAK, " ") for x in texts])


def medication_flags(t: Tables, faithful: bool = True) -> DataFrame:
    """Drug exposures by stay. ``faithful``: the texts as the study writes them, with no-break spaces."""
    acetaminophen = _listed("drugname", fixed.ACETAMINOPHEN_DRUGS, faithful)
    nsaid = _listed("drugname", fixed.NSAID_DRUGS, faithful)
    rows = in_window(t["medication"], "drugstartoffset", EXPOSURE_WINDOW).where(acetaminophen | nsaid)
    return rows.groupBy(STAY).agg(_flag_any(acetaminophen, "acetaminophen_rx"), _flag_any(nsaid, "nsaid_rx"))


def cooling_care(t: Tables, faithful: bool = True) -> DataFrame:
    rows = in_window(t["nursecare"], "nursecareoffset", EXPOSURE_WINDOW).where(
        _listed("cellattributevalue", fixed.COOLING_CARE, faithful)
    )
    return rows.groupBy(STAY).agg(F.lit(1).alias("cooling_care"))


def _either(*names: str) -> Column:
    known = [F.coalesce(F.col(n), F.lit(0)) for n in names]
    return (F.greatest(*known) if len(known) > 1 else known[0]).cast("int")


def _care_columns() -> dict[str, Column]:
    """Completed flags of a stay row that has been left-joined to the event flags."""
    return {
        **{n: _either(n) for n in INTERVENTIONS},
        "acetaminophen_flag": _either("acetaminophen_rx", "acetaminophen_tx"),
        "nsaid_flag": _either("nsaid_rx", "nsaid_tx"),
        "cooling_flag": _either("cooling_care", "cooling_tx"),
    }


def interventions_and_exposures(t: Tables, faithful: bool = True) -> DataFrame:
    """Ten intervention flags and three exposure flags for every stay."""
    out = t["patient"].select(STAY).distinct()
    for frame in (treatment_flags(t), medication_flags(t, faithful), cooling_care(t, faithful)):
        out = out.join(frame, STAY, "left")
    return out.select(STAY, *[c.alias(n) for n, c in _care_columns().items()])


def lab_extremes(t: Tables, faithful: bool = True) -> DataFrame:
    """Day-1 laboratory extremes and the neutrophil/lymphocyte ratio per stay.

    ``faithful``: haemoglobin, haematocrit and platelets are day-1 maxima despite
    their names, and AST rows escape their range rule. Otherwise minima and the
    intended AST name are used.
    """
    low = "max" if faithful else "min"
    ast = fixed.AST_SELECTED if faithful else fixed.AST_INTENDED
    outputs = {
        "WBC_max": ("max", "WBC x 1000"),
        "_polys": ("max", "-polys"),
        "_lymphs": ("max", "-lymphs"),
        "HGB_min": (low, "Hgb"),
        "HCT_min": (low, "Hct"),
        "PLT_min": (low, "platelets x 1000"),
        "LAC_max": ("max", "lactate"),
        "ALT_max": ("max", "ALT (SGPT)"),
        "AST_max": ("max", ast),
        "BIL_max": ("max", "total bilirubin"),
        "BUN_max": ("max", "BUN"),
        "SCR_max": ("max", "creatinine"),
    }
    rows = in_window(t["lab"], "labresultoffset", DAY_1).where(
        F.col("labname").isin([m for _, m in outputs.values()])
    )
    wide = pivot_extremes(rows, [STAY], "labname", "labresult", outputs, fixed.LAB_LIMITS)
    return ratio_of_extremes(wide, "_polys", "_lymphs", "NLR_max").drop("_polys", "_lymphs")


def urine_output(t: Tables) -> DataFrame:
    return summarise_window(t["pivoted_uo"], STAY, "chartoffset", DAY_1, {"uo_24h": ("sum", "urineoutput")})


def oxygenation(t: Tables) -> DataFrame:
    """Least PaO2/FiO2 on day 1, FiO2 in percent as charted; 0 counts as room air."""
    rows = in_window(t["pivoted_bg"], "chartoffset", DAY_1)
    return extreme_ratio(rows, STAY, "pao2", "fio2", "OI_min", "min", fixed.ROOM_AIR_FIO2)


def haemodynamics(t: Tables) -> DataFrame:
    return summarise_window(
        t["pivoted_vital_other"], STAY, "chartoffset", WEEK_1,
        {"CO_min": ("min", "co"), "CI_min": ("min", "ci"), "SVO2_min": ("min", "svo2"),
         "SVR_max": ("max", "svr"), "SVRI_max": ("max", "svri")},
    )


def pressure_series(t: Tables, faithful: bool = True) -> DataFrame:
    """Invasive and non-invasive mean pressure in one series.

    ``faithful``: invasive values count at any time, non-invasive ones on day 1.
    """
    vital = t["pivoted_vital"]
    day1 = in_window(vital, "chartoffset", DAY_1)
    return merge_series(
        [(vital if faithful else day1, "ibp_mean"), (day1, "nibp_mean")], [STAY, "chartoffset"], "MAP"
    )


VITAL_OUTPUTS = {
    "HR_max": ("max", "heartrate"), "HR_avg": ("avg", "heartrate"),
    "RR_max": ("max", "respiratoryrate"), "RR_avg": ("avg", "respiratoryrate"),
    "SpO2_min": ("min", "spo2"), "SpO2_avg": ("avg", "spo2"),
}


def vital_summary(t: Tables, faithful: bool = True) -> DataFrame:
    """Day-1 vital signs; only stays with a day-1 vital row have a record.

    The pressure of ``pressure_series`` is summarised in the same aggregation, so
    the vitals are read and shuffled once.
    """
    day1 = F.col("chartoffset").between(*DAY_1)
    invasive = F.col("ibp_mean") if faithful else F.when(day1, F.col("ibp_mean"))
    cuff = F.when(day1, F.col("nibp_mean"))
    used = day1 | F.col("ibp_mean").isNotNull() if faithful else day1
    signs = [AGGREGATES[how](F.when(day1, F.col(c))).alias(n) for n, (how, c) in VITAL_OUTPUTS.items()]
    total = F.coalesce(F.sum(invasive), F.lit(0.0)) + F.coalesce(F.sum(cuff), F.lit(0.0))
    return (
        t["pivoted_vital"].where(used).groupBy(STAY)
        .agg(F.max(F.when(day1, 1)).alias("_seen"), *signs,
             F.min(F.least(invasive, cuff)).alias("MAP_min"),
             (total / F.nullif(F.count(invasive) + F.count(cuff), F.lit(0))).alias("MAP_avg"))
        .where("_seen = 1").drop("_seen")
    )


def sited_temperatures(t: Tables) -> DataFrame:
    """Day-1 temperatures with mapped site; an unlisted or unknown site is peripheral."""
    rows = in_window(t["pivoted_vital"], "chartoffset", DAY_1).where(F.col("temperature").isNotNull())
    core = F.coalesce(F.col("tempsite_flag").isin(*fixed.CORE_SITES), F.lit(False)).cast("int")
    return lookup(rows, t["tempsite"], ["temperaturelocation"]).select(
        STAY, "chartoffset", F.col("temperature").alias("temp"), "temperaturelocation", "tempsite_flag",
        core.alias("coretemp_flag"),
    )


def temperature_extremes(t: Tables) -> DataFrame:
    core = F.coalesce(F.col("tempsite_flag").isin(*fixed.CORE_SITES), F.lit(False))
    wide = tagged_extremes(
        sited_temperatures(t), STAY, "temp", "tempsite_flag", {"all": None, "peri": ~core, "core": core}
    )
    return wide.select(STAY, *_temperature_columns())


def _temperature_columns() -> list[Column]:
    out = [F.col("max_all").alias("T_max"), F.col("min_all").alias("T_min")]
    for part in ("peri", "core"):
        out += [
            F.col(f"max_{part}").alias(f"T_max_{part}"),
            F.col(f"max_{part}_tempsite_flag").alias(f"tmax_{part}"),
            F.col(f"min_{part}").alias(f"T_min_{part}"),
            F.col(f"min_{part}_tempsite_flag").alias(f"tmin_{part}"),
            present(f"max_{part}").alias(f"t_{part}_flag"),
        ]
    return out


def vital_record(t: Tables, faithful: bool = True) -> DataFrame:
    """Day-1 vital signs and sited temperatures of every stay with a mapped day-1 temperature, from one read of the vital signs.

    Same columns as ``vital_summary`` and ``temperature_extremes``. The first level has a row of sums, counts and extremes
    per stay and site; only these rows meet the mapping.
    """
    day1 = F.col("chartoffset").between(*DAY_1)
    invasive = F.col("ibp_mean") if faithful else F.when(day1, F.col("ibp_mean"))
    cuff = F.when(day1, F.col("nibp_mean"))
    used = day1 | F.col("ibp_mean").isNotNull() if faithful else day1
    states, merged = [], []
    for name, (how, column) in VITAL_OUTPUTS.items():
        value = F.when(day1, F.col(column))
        if how == "avg":
            states += [F.sum(value).alias(f"_{name}_s"), F.count(value).alias(f"_{name}_n")]
            merged.append((F.sum(f"_{name}_s") / F.nullif(F.sum(f"_{name}_n"), F.lit(0))).alias(name))
        else:
            states.append(AGGREGATES[how](value).alias(f"_{name}"))
            merged.append(AGGREGATES[how](f"_{name}").alias(name))
    temperature = F.when(day1, F.col("temperature"))
    states += [
        F.min(F.least(invasive, cuff)).alias("_low"), F.sum(invasive).alias("_ibp"), F.sum(cuff).alias("_nibp"),
        (F.count(invasive) + F.count(cuff)).alias("_pressures"), F.max(temperature).alias("temp_hi"), F.min(temperature).alias("temp_lo"),
    ]
    pressure = F.coalesce(F.sum("_ibp"), F.lit(0.0)) + F.coalesce(F.sum("_nibp"), F.lit(0.0))
    merged += [F.min("_low").alias("MAP_min"), (pressure / F.nullif(F.sum("_pressures"), F.lit(0))).alias("MAP_avg")]

    core = F.coalesce(F.col("tempsite_flag").isin(*fixed.CORE_SITES), F.lit(False))
    subsets = {"all": None, "peri": ~core, "core": core}
    sites = tag_choices(t["tempsite"], "temperaturelocation", "tempsite_flag", subsets)
    by_site = t["pivoted_vital"].where(used).groupBy(STAY, "temperaturelocation").agg(*states)
    placed = by_site.join(bounded(sites) or sites, "temperaturelocation", "left")
    record = placed.groupBy(STAY).agg(*merged, *merged_extremes("temp", "tempsite_flag", list(subsets)))
    signs = [*VITAL_OUTPUTS, "MAP_min", "MAP_avg"]
    return record.where("max_all IS NOT NULL").select(STAY, *signs, *_temperature_columns())


def _numbered_stays(t: Tables, faithful: bool, first_only: bool) -> DataFrame:
    """Eligible stays with their number among those of the person, diagnoses, vital signs and region.

    Stays are numbered with the patient's columns alone; vital signs and diagnoses have a row per stay and join afterwards.
    """
    vital, found = vital_record(t, faithful), diagnosed(t)
    eligible = (
        t["patient"].join(vital.select(STAY), STAY).join(found.select(STAY, "exclusion_flag"), STAY, "left")
        .where(_either("exclusion_flag") == 0).drop("exclusion_flag")
    )
    order = ["patienthealthsystemstayid", STAY, "unitvisitnumber"]
    numbered = number_episodes(eligible, PERSON, order)
    if first_only:
        numbered = numbered.where("seqnum = 1")
    placed = numbered.join(hospitals(t), "hospitalid", "left")
    return placed.join(vital, STAY).join(found.drop("exclusion_flag"), STAY, "left")


def _largest(t: Tables, table: str, column: str, name: str, least: int | None = None) -> DataFrame:
    rows = t[table] if least is None else t[table].where(F.col(column) >= least)
    return rows.groupBy(STAY).agg(F.max(column).alias(name))


def assemble(t: Tables, faithful: bool = True, first_only: bool = False, store: StageStore | None = None, inputs: str = "") -> DataFrame:
    """The 84-column record of every eligible stay, or of first stays only.

    Eligible: no exclusion diagnosis and a mapped day-1 temperature. Stays are
    numbered per person among the eligible ones, before any other filter.

    With a ``store`` every part is a stage in buckets of the stay, built once for the same ``inputs`` (a text that names
    the tables and their state), and the star of left joins shuffles nothing.
    """
    parts: dict[str, Callable[[], DataFrame]] = {
        "stays_first" if first_only else "stays": lambda: _numbered_stays(t, faithful, first_only),
        "sofa": lambda: _largest(t, "sofascore", "sofatotal", "_sofa", fixed.MIN_SOFA),
        "score": lambda: _largest(t, "apachepatientresult", "apachescore", "apache_iv"),
        "diagnosis_group": lambda: _largest(t, "apache_groups", "apachedxgroup", "apachedxgroup"),
        "treatment": lambda: treatment_flags(t),
        "medication": lambda: medication_flags(t, faithful),
        "cooling": lambda: cooling_care(t, faithful),
        "labs": lambda: lab_extremes(t, faithful),
        "urine": lambda: urine_output(t),
        "oxygenation": lambda: oxygenation(t),
        "haemodynamics": lambda: haemodynamics(t),
    }
    out = None
    for name, build in parts.items():
        part = build() if store is None else store.keep(name, f"{inputs} faithful={faithful}", build, STAY)
        out = part if out is None else out.join(part, STAY, "left")
    out = out.withColumn("sofa", F.when(F.col("infected") == 1, F.col("_sofa")))
    derived = {
        "hosp_mortality": vital_status("hospitaldischargestatus"),
        "icu_mortality": vital_status("unitdischargestatus"),
        "gender": sex_code("gender"),
        "icu_los_hours": whole_hours("unitdischargeoffset"),
        "hosp_los_hours": whole_hours(F.col("hospitaldischargeoffset") - F.col("hospitaladmitoffset")),
        "sepsis_flag": present("sofa"),
        **{n: _either(n) for n in COMORBIDITIES if n != "exclusion_flag"},
        **_care_columns(),
    }
    return out.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in COHORT_COLUMNS])


def select_cohort(records: DataFrame, sepsis: bool = True) -> DataFrame:
    """First stays of at least a day, with (or without) sepsis."""
    return records.where(
        (F.col("seqnum") == 1)
        & (F.col("icu_los_hours") >= fixed.MIN_ICU_HOURS)
        & (F.col("sepsis_flag") == int(sepsis))
    )


def cohort(t: Tables, sepsis: bool = True, faithful: bool = True) -> DataFrame:
    """The study cohort: the record of each selected person's first stay."""
    return select_cohort(assemble(t, faithful, first_only=True), sepsis)
