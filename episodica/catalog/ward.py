"""An ICU ward derived from the sample tables, and the cohort queries over it.

Every clinical table is one portable SELECT over orders, order lines or nations,
run by Spark for the query and by DuckDB for its SQL twin; all grow with the
sample tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.operators.rules import CodeRule
from episodica.plans import code_lists as fixed
from episodica.plans import cohort as plan
from episodica.sources.tables import dealt

DIAGNOSES = (
    "pulmonary|disorders of the airways|COPD|mild", "cardiovascular|vascular disorders|hypertension|primary",
    "renal|disorder of kidney|chronic kidney disease|stage 3", "oncology|GI tumors|colon",
    "infectious diseases|systemic/other infections|septic shock|culture positive",
    "infectious diseases|systemic/other infections|sepsis", "pulmonary|pulmonary infections|pneumonia",
    "endocrine|glucose metabolism|diabetes mellitus|Type II", "renal|electrolyte imbalance|hypokalemia",
    "cardiovascular|ventricular disorders|congestive heart failure|severe",
    "gastrointestinal|intestinal disease|GI obstruction / ileus|small bowel|tumor",
    "gastrointestinal|intestinal disease|viscus perforation|colon|due to tumor",
    "neurologic|neuromuscular disorders|neuropathy|from diabetes",
    "renal|disorder of kidney|ESRD (end stage renal disease)",
    "pulmonary|pleural disorders|pleural effusion|due to heart failure",
    "cardiovascular|ventricular disorders|cardiomyopathy|hypertrophic|hypertensive with LVH",
    "cardiovascular|shock / hypotension|septic shock", "surgery|infections|wound infection",
    "neurologic|disorders of vasculature|bleed|secondary to trauma", "hematology|anemia",
    "cardiovascular|cardiac arrest|cardiac arrest|witnessed",
    "neurologic|post-neurosurgery|post craniotomy", "pulmonary|respiratory failure|acute",
    "Pulmonary|disorders of the airways|COPD", "gastrointestinal|abdominal|pain",
    "cardiovascular|chest pain / ASHD|acute coronary syndrome", "pulmonary|respiratory failure|hypoxia",
    "hematology|bleeding", "endocrine|fluids and electrolytes|hyponatremia", "toxicology|drug overdose",
)
INFECTIONS = (
    "infectious diseases|systemic/other infections|septic shock|culture positive",
    "infectious diseases|systemic/other infections|sepsis", "pulmonary|pulmonary infections|pneumonia",
    "cardiovascular|shock / hypotension|septic shock", "surgery|infections|wound infection",
)
TREATMENTS = (
    "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|assist controlled",
    "pulmonary|surgery / incision and drainage of thorax|tracheostomy", "renal|dialysis|hemodialysis",
    "renal|electrolyte correction|treatment of hyperkalemia|dialysis",
    "cardiovascular|shock|vasopressors|norepinephrine <= 0.1 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|epinephrine > 0.1 micrograms/kg/min",
    "cardiovascular|shock|inotropic agent|dopamine <= 5 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|dopamine  5-15 micrograms/kg/min",
    "cardiovascular|shock|vasopressors|dopamine 5-15 micrograms/kg/min",
    "toxicology|drug overdose|vasopressors|dopamine >15 micrograms/kg/min",
    "cardiovascular|ventricular dysfunction|inotropic agent|dobutamine",
    "infectious diseases|medications|therapeutic antibacterials|vancomycin", "renal|medications|systemic antibiotics",
    "surgery|wounds / temperature|antipyretics|acetaminophen", "surgery|wounds / temperature|antipyretics|NSAID",
    "surgery|wounds / temperature|cooling the patient", "gastrointestinal|medications|stress ulcer prophylaxis",
    "surgery|wounds / temperature|antipyretics|acetaminophen|oral", "neurologic|pain / agitation|analgesics",
    "cardiovascular|consultations|cardiology", "pulmonary|medications|bronchodilator", "general|support services",
)
LABS = (*[n for n in fixed.LAB_LIMITS if n != fixed.AST_INTENDED], fixed.AST_SELECTED, fixed.AST_INTENDED, "sodium")
DRUGS = ("ACETAMINOPHEN", "acetaminophen (TYLENOL) tab 650 mg", "KETOROLAC INJ", "IBUPROFEN", "HEPARIN",
         "ACETAMINOPHEN  325 MG ORAL TAB", "acetaminophen  325 mg", "INSULIN", "PROPOFOL", "FENTANYL", "SALINE",
         "acetaminophen\u00a0(TYLENOL)\u00a0tab\u00a0650\u00a0mg", "KETOROLAC\u00a0INJ",
         "ACETAMINOPHEN\u00a0\u00a0325\u00a0MG\u00a0ORAL\u00a0TAB", "KETOROLAC\u00a0 INJ")
CARE = ("ice bag", "heating/cooling blanket", "Ice Bag", "turned", "ice\u00a0bag", "heating/cooling\u00a0blanket")
UNITS = ("Med-Surg ICU", "CSICU", "CTICU", "CCU-CTICU", "Cardiac ICU", "Neuro ICU", "MICU")
ETHNICITIES = ("Caucasian", "African American", "Hispanic", "Asian", "Native American", "", "Other/Unknown")
PLACES = ("Oral", "BLADDER", "AXILLARY", "ESOPH", "ROOM")
SITES = (("Oral", "Oral"), ("BLADDER", "Bladder"), ("AXILLARY", None), ("ESOPH", "Esophageal"))


def choose(index: str, values: Sequence[str]) -> str:
    """CASE that picks the value at a 0-based index; other indexes give NULL."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


STAY = "patientunitstayid"
LINE = f"CAST(l_orderkey AS BIGINT) AS {STAY}"

# name -> (source, select list); "lines6" is the order lines with r = 0..5.
WARD = {
    "patient": ("orders", f"""
        concat('P', CAST(o_custkey + 7919 * (o_orderkey % 4) AS STRING)) AS uniquepid,
        CAST(o_orderkey * 10 AS BIGINT) AS patienthealthsystemstayid, CAST(o_orderkey AS BIGINT) AS {STAY},
        CAST(CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS unitvisitnumber,
        CAST(o_custkey % 26 AS BIGINT) AS hospitalid, {choose('o_orderkey % 7', UNITS)} AS unittype,
        CAST(-(o_orderkey % 3000) AS BIGINT) AS hospitaladmitoffset,
        CAST(floor(o_totalprice) AS BIGINT) % 10007 + o_orderkey % 20011 AS hospitaldischargeoffset,
        CAST(floor(o_totalprice) AS BIGINT) % 10007 AS unitdischargeoffset,
        CAST(2014 + o_orderkey % 2 AS BIGINT) AS hospitaldischargeyear,
        CASE WHEN o_orderkey % 31 = 0 THEN '> 89' WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 41 = 0 THEN NULL
             ELSE CAST(14 + (o_orderkey * 7) % 76 AS STRING) END AS age,
        o_orderpriority AS apacheadmissiondx,
        CASE WHEN o_orderstatus = 'F' THEN 'Expired' WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'Alive' END
          AS hospitaldischargestatus,
        CASE WHEN o_orderkey % 5 = 0 THEN 'EXPIRED' ELSE 'alive' END AS unitdischargestatus,
        CASE WHEN o_orderkey % 43 = 0 THEN 'Unknown' WHEN o_orderkey % 9 < 4 THEN 'Female' ELSE 'Male' END AS gender,
        {choose('(o_orderkey + o_custkey) % 7', ETHNICITIES)} AS ethnicity,
        CAST(CASE WHEN o_orderkey % 47 = 0 THEN 30 WHEN o_orderkey % 53 = 0 THEN 310 ELSE 140 + o_orderkey % 60 END
             AS DOUBLE) AS admissionheight,
        CAST(CASE WHEN o_orderkey % 59 = 0 THEN 5 ELSE 40 + o_custkey % 90 END AS DOUBLE) AS admissionweight"""),
    "diagnosis": ("lineitem", f"""
        {LINE}, {choose('(l_partkey * 7 + l_suppkey) % 31', DIAGNOSES)} AS diagnosisstring,
        CAST((l_partkey * 37 + l_linenumber * 101) % 4000 - 2000 AS BIGINT) AS diagnosisoffset"""),
    "treatment": ("lineitem", f"""
        {LINE}, {choose('(l_partkey * 3 + l_suppkey * 5) % 24', TREATMENTS)} AS treatmentstring,
        CAST((l_partkey * 29 + l_linenumber * 211) % 3000 - 600 AS BIGINT) AS treatmentoffset"""),
    "lab": ("lines6", f"""
        {LINE}, {choose(f'(l_suppkey + r * 5 + l_linenumber) % {len(LABS)}', LABS)} AS labname,
        CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice ELSE l_quantity * (r + 1) / 4 END AS labresult,
        CAST((l_partkey * 13 + r * 211) % 1800 - 200 AS BIGINT) AS labresultoffset"""),
    "microlab": ("lineitem", f"""
        {LINE}, {choose('l_partkey % 5', ('no growth', 'No Growth', 'E. coli', 'Staphylococcus'))} AS organism,
        CAST((l_partkey * 17 + l_suppkey) % 4000 - 2000 AS BIGINT) AS culturetakenoffset"""),
    "medication": ("lineitem", f"""
        {LINE}, {choose('l_partkey % 16', DRUGS)} AS drugname,
        CAST((l_partkey * 19 + l_suppkey) % 3000 - 600 AS BIGINT) AS drugstartoffset"""),
    "nursecare": ("lineitem", f"""
        {LINE}, CAST((l_partkey * 23 + l_suppkey) % 3000 - 600 AS BIGINT) AS nursecareoffset,
        {choose('l_partkey % 13', CARE)} AS cellattributevalue"""),
    "pivoted_vital": ("lines6", f"""
        {LINE}, CAST((l_partkey * 31 + r * 307) % 2200 - 100 AS BIGINT) AS chartoffset,
        CAST(CASE WHEN r = 5 THEN NULL ELSE 50 + (l_suppkey + r * 7) % 100 END AS DOUBLE) AS heartrate,
        CAST(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 8 + (l_partkey + r) % 30 END AS DOUBLE) AS respiratoryrate,
        CAST(80 + (l_partkey + l_suppkey + r) % 21 AS DOUBLE) AS spo2,
        CAST(CASE WHEN r % 3 = 0 THEN 40 + (l_partkey + r) % 80 END AS DOUBLE) AS ibp_mean,
        CAST(CASE WHEN r % 3 = 1 THEN 45 + (l_suppkey + r) % 80 END AS DOUBLE) AS nibp_mean,
        CAST(CASE WHEN r % 2 = 0 THEN 345 + (l_partkey + l_suppkey * 3 + r * 11) % 55 END AS DOUBLE) / 10 AS temperature,
        {choose('(l_linenumber + r) % 6', PLACES)} AS temperaturelocation"""),
    "pivoted_vital_other": ("lineitem", f"""
        {LINE}, CAST((l_partkey * 41) % 14000 - 500 AS BIGINT) AS chartoffset,
        l_quantity / 8 AS co, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 16 END AS ci,
        50 + l_quantity / 2 AS svo2, 600 + l_quantity * 8 AS svr, 900 + l_quantity * 16 AS svri"""),
    "pivoted_bg": ("lineitem", f"""
        {LINE}, CAST((l_partkey * 43) % 2000 - 100 AS BIGINT) AS chartoffset,
        CAST(CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 50 + l_suppkey % 150 END AS DOUBLE) AS pao2,
        CAST(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 21 WHEN 2 THEN 50 END AS DOUBLE) AS fio2"""),
    "pivoted_uo": ("lineitem", f"""
        {LINE}, CAST((l_partkey * 47) % 2000 - 100 AS BIGINT) AS chartoffset, l_quantity * 10 AS urineoutput"""),
    "apachepatientresult": ("orders", f"""
        CAST(o_orderkey AS BIGINT) AS {STAY},
        CAST(CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE (o_orderkey * 11) % 150 END AS DOUBLE) AS apachescore"""),
    "apache_groups": ("orders", f"""
        CAST(o_orderkey AS BIGINT) AS {STAY}, concat('Group ', CAST(o_orderkey % 10 AS STRING)) AS apachedxgroup"""),
    "hospital": ("nation", f"""
        CAST(n_nationkey AS BIGINT) AS hospitalid,
        {choose('n_regionkey', ('Midwest', 'South', 'West', 'Northeast'))} AS region"""),
    "sofascore": ("orders", f"""
        CAST(o_orderkey AS BIGINT) AS {STAY}, CAST((o_orderkey * 13) % 11 AS BIGINT) AS sofatotal"""),
}


#: Columns that the ward is made of.
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def ward_tables(s: Sample, by_stay: bool = False) -> dict[str, DataFrame]:
    """The ward's tables. ``by_stay``: only rows with a known stay, orders and lines dealt by it once before the tables are made of them."""
    orders, lines = s.table("orders").select(*ORDER_COLUMNS), s.table("lineitem").select(*LINE_COLUMNS)
    if by_stay:
        orders, lines = dealt(orders, "o_orderkey"), dealt(lines, "l_orderkey")
    sources = {
        "orders": orders, "lineitem": lines, "nation": s.table("nation"),
        "lines6": lines.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(5)))),
    }
    out = {
        name: s.spark.sql(f"SELECT {columns} FROM {{source}}", source=sources[source])
        for name, (source, columns) in WARD.items()
    }
    out["infection_diagnosis"] = s.spark.createDataFrame([(c,) for c in INFECTIONS], "diagnosisstring string")
    out["tempsite"] = s.spark.createDataFrame(list(SITES), "temperaturelocation string, tempsite_flag string")
    return out


def _text(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


def ward_sql() -> str:
    """The ward tables as CTEs for DuckDB."""
    ctes = ["lines6 AS (SELECT *, unnest(range(0, 6)) AS r FROM lineitem)"]
    ctes += [f"{n} AS (SELECT {columns} FROM {source})" for n, (source, columns) in WARD.items()]
    ctes.append("infection_diagnosis(diagnosisstring) AS (VALUES " + ", ".join(f"('{c}')" for c in INFECTIONS) + ")")
    ctes.append("tempsite(temperaturelocation, tempsite_flag) AS (VALUES "
                + ", ".join(f"({_text(a)}, {_text(b)})" for a, b in SITES) + ")")
    return ",\n".join(ctes)


def rule_sql(rule: CodeRule, code: str) -> str:
    tests = [f"{code} LIKE '{p}%'" for p in rule.prefixes] + [f"{code} LIKE '{p}'" for p in rule.patterns]
    tests += [f"{code} = '{x}'" for x in rule.exact]
    positive = " OR ".join(tests)
    if rule.veto:
        veto = " OR ".join(f"{code} LIKE '{v}%'" for v in rule.veto)
        return f"CASE WHEN {veto} THEN 0 WHEN {positive} THEN 1 ELSE 0 END"
    return f"CASE WHEN {positive} THEN 1 ELSE 0 END"


def _listed(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _lab(name: str, how: str = "max") -> str:
    limits = fixed.LAB_LIMITS.get(name)
    value = f"CASE WHEN labresult BETWEEN {limits[0]} AND {limits[1]} THEN labresult END" if limits else "labresult"
    return f"{how}({value}) FILTER (labname = '{name}' AND labresultoffset BETWEEN 0 AND 1440)"


def records_sql() -> str:
    """The 84-column records written the direct way: ranks, row-wise joins, one row per join partner."""
    k = STAY
    dx = ", ".join(f"max({rule_sql(r, 'diagnosisstring')}) AS {r.flag}" for r in fixed.DIAGNOSIS_RULES)
    tx = ", ".join(f"max({rule_sql(r, 'treatmentstring')}) AS {r.flag}" for r in fixed.TREATMENT_RULES)
    core = _listed(fixed.CORE_SITES)
    near = "BETWEEN -360 AND 1800"

    def exposed(name: str, *sources: str) -> str:
        tests = " OR ".join(f"p.{k} IN ({q})" for q in sources)
        return f"CASE WHEN {tests} THEN 1 ELSE 0 END AS {name}"

    def ranked(condition: str, direction: str) -> str:
        tag = "DESC NULLS LAST" if direction == "DESC" else "ASC NULLS FIRST"
        return (f"(SELECT {k}, temperature, tempsite_flag FROM temps WHERE {condition} "
                f"QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY temperature {direction}, tempsite_flag {tag}) = 1)")

    flags = ", ".join(f"d.{r.flag}" for r in fixed.DIAGNOSIS_RULES if r.flag != "exclusion_flag")
    care = ", ".join(f"t.{r.flag}" for r in fixed.TREATMENT_RULES)
    peri = f"coalesce(tempsite_flag NOT IN {core}, true)"
    return f"""
    WITH {ward_sql()},
    temps AS (SELECT v.{k}, v.temperature, m.tempsite_flag FROM pivoted_vital v JOIN tempsite m USING (temperaturelocation)
              WHERE v.temperature IS NOT NULL AND v.chartoffset BETWEEN 0 AND 1440),
    maps AS (SELECT {k}, ibp_mean AS m FROM pivoted_vital WHERE ibp_mean IS NOT NULL
             UNION ALL SELECT {k}, nibp_mean FROM pivoted_vital WHERE nibp_mean IS NOT NULL AND chartoffset BETWEEN 0 AND 1440),
    vit AS (SELECT v.{k}, max(heartrate) AS HR_max, avg(heartrate) AS HR_avg, max(respiratoryrate) AS RR_max,
              avg(respiratoryrate) AS RR_avg, min(spo2) AS SpO2_min, avg(spo2) AS SpO2_avg, min(m) AS MAP_min, avg(m) AS MAP_avg
            FROM pivoted_vital v LEFT JOIN maps USING ({k}) WHERE chartoffset BETWEEN 0 AND 1440 GROUP BY 1),
    infected AS (SELECT DISTINCT s.{k}, s.sofatotal AS sofa FROM diagnosis d
                 JOIN infection_diagnosis i USING (diagnosisstring)
                 JOIN sofascore s ON s.{k} = d.{k} AND s.sofatotal >= 2 WHERE d.diagnosisoffset BETWEEN -1440 AND 1440),
    dx AS (SELECT p.{k}, {dx} FROM patient p LEFT JOIN diagnosis d USING ({k}) GROUP BY 1),
    tx AS (SELECT p.{k}, {tx} FROM patient p LEFT JOIN treatment t USING ({k}) GROUP BY 1),
    labs AS (SELECT {k}, {_lab('WBC x 1000')} AS WBC_max, {_lab('-polys')} AS polys, {_lab('-lymphs')} AS lymphs,
               {_lab('Hgb')} AS HGB_min, {_lab('Hct')} AS HCT_min, {_lab('platelets x 1000')} AS PLT_min,
               {_lab('lactate')} AS LAC_max, {_lab('ALT (SGPT)')} AS ALT_max, {_lab('AST (SGPT)')} AS AST_max,
               {_lab('total bilirubin')} AS BIL_max, {_lab('BUN')} AS BUN_max, {_lab('creatinine')} AS SCR_max
             FROM lab GROUP BY 1),
    uo AS (SELECT {k}, sum(urineoutput) AS uo_24h FROM pivoted_uo WHERE chartoffset BETWEEN 0 AND 1440 GROUP BY 1),
    oi AS (SELECT {k}, min(pao2 / CASE WHEN fio2 = 0 THEN 21 ELSE fio2 END) AS OI_min FROM pivoted_bg
           WHERE chartoffset BETWEEN 0 AND 1440 AND pao2 IS NOT NULL AND fio2 IS NOT NULL GROUP BY 1),
    he AS (SELECT {k}, min(co) AS CO_min, min(ci) AS CI_min, min(svo2) AS SVO2_min, max(svr) AS SVR_max, max(svri) AS SVRI_max
           FROM pivoted_vital_other WHERE chartoffset BETWEEN 0 AND 10080 GROUP BY 1),
    ex AS (SELECT p.{k},
        {exposed('acetaminophen_flag',
                 f"SELECT {k} FROM medication WHERE drugname IN {_listed(fixed.ACETAMINOPHEN_DRUGS)} AND drugstartoffset {near}",
                 f"SELECT {k} FROM treatment WHERE treatmentstring IN {_listed(fixed.ACETAMINOPHEN_TREATMENTS)} AND treatmentoffset {near}")},
        {exposed('nsaid_flag',
                 f"SELECT {k} FROM medication WHERE drugname IN {_listed(fixed.NSAID_DRUGS)} AND drugstartoffset {near}",
                 f"SELECT {k} FROM treatment WHERE treatmentstring IN {_listed(fixed.NSAID_TREATMENTS)} AND treatmentoffset {near}")},
        {exposed('cooling_flag',
                 f"SELECT {k} FROM nursecare WHERE cellattributevalue IN {_listed(fixed.COOLING_CARE)} AND nursecareoffset {near}",
                 f"SELECT {k} FROM treatment WHERE treatmentstring IN {_listed(fixed.COOLING_TREATMENTS)} AND treatmentoffset {near}")}
        FROM patient p),
    records AS (
      SELECT p.uniquepid, p.patienthealthsystemstayid, p.{k}, p.unitvisitnumber, p.hospitalid, h.region, p.unittype,
        p.hospitaladmitoffset, p.hospitaldischargeoffset, p.unitdischargeoffset, a.apachescore AS apache_iv,
        p.hospitaldischargeyear, p.age, p.apacheadmissiondx, g.apachedxgroup,
        CASE WHEN p.hospitaldischargestatus ILIKE '%alive%' THEN 0 WHEN p.hospitaldischargestatus ILIKE '%expired%' THEN 1 END AS hosp_mortality,
        CASE WHEN p.unitdischargestatus ILIKE '%alive%' THEN 0 WHEN p.unitdischargestatus ILIKE '%expired%' THEN 1 END AS icu_mortality,
        CASE WHEN p.gender ILIKE '%female%' THEN 0 WHEN p.gender ILIKE '%male%' THEN 1 END AS gender,
        p.ethnicity, p.admissionheight, p.admissionweight,
        round(p.unitdischargeoffset / 60.0) AS icu_los_hours,
        round((p.hospitaldischargeoffset - p.hospitaladmitoffset) / 60.0) AS hosp_los_hours,
        i.sofa, CASE WHEN i.sofa IS NOT NULL THEN 1 ELSE 0 END AS sepsis_flag, {flags}, {care},
        l.WBC_max, l.HGB_min, l.HCT_min, l.PLT_min, l.LAC_max, l.ALT_max, l.AST_max, l.BIL_max, l.BUN_max, l.SCR_max,
        round(CASE WHEN l.polys > 0 AND l.lymphs > 0 THEN l.polys / l.lymphs END, 6) AS NLR_max,
        uo.uo_24h, round(oi.OI_min, 6) AS OI_min, he.CO_min, he.CI_min, he.SVO2_min, he.SVR_max, he.SVRI_max,
        v.HR_max, round(v.HR_avg, 6) AS HR_avg, v.RR_max, round(v.RR_avg, 6) AS RR_avg, v.SpO2_min,
        round(v.SpO2_avg, 6) AS SpO2_avg, v.MAP_min, round(v.MAP_avg, 6) AS MAP_avg,
        x1.temperature AS T_max, x2.temperature AS T_min,
        x3.temperature AS T_max_peri, x3.tempsite_flag AS tmax_peri, x4.temperature AS T_min_peri, x4.tempsite_flag AS tmin_peri,
        CASE WHEN x3.temperature IS NOT NULL THEN 1 ELSE 0 END AS t_peri_flag,
        x5.temperature AS T_max_core, x5.tempsite_flag AS tmax_core, x6.temperature AS T_min_core, x6.tempsite_flag AS tmin_core,
        CASE WHEN x5.temperature IS NOT NULL THEN 1 ELSE 0 END AS t_core_flag,
        ex.acetaminophen_flag, ex.nsaid_flag, ex.cooling_flag,
        CAST(row_number() OVER (PARTITION BY p.uniquepid ORDER BY p.patienthealthsystemstayid, p.{k}, p.unitvisitnumber) AS INTEGER) AS seqnum
      FROM patient p
      JOIN dx d ON d.{k} = p.{k} AND d.exclusion_flag = 0
      JOIN {ranked('true', 'DESC')} x1 ON x1.{k} = p.{k}
      LEFT JOIN {ranked('true', 'ASC')} x2 ON x2.{k} = p.{k}
      LEFT JOIN {ranked(peri, 'DESC')} x3 ON x3.{k} = p.{k}
      LEFT JOIN {ranked(peri, 'ASC')} x4 ON x4.{k} = p.{k}
      LEFT JOIN {ranked(f'tempsite_flag IN {core}', 'DESC')} x5 ON x5.{k} = p.{k}
      LEFT JOIN {ranked(f'tempsite_flag IN {core}', 'ASC')} x6 ON x6.{k} = p.{k}
      LEFT JOIN infected i ON i.{k} = p.{k} LEFT JOIN apachepatientresult a ON a.{k} = p.{k}
      LEFT JOIN hospital h ON h.hospitalid = p.hospitalid LEFT JOIN apache_groups g ON g.{k} = p.{k}
      LEFT JOIN tx t ON t.{k} = p.{k} LEFT JOIN labs l ON l.{k} = p.{k} LEFT JOIN uo ON uo.{k} = p.{k}
      LEFT JOIN oi ON oi.{k} = p.{k} LEFT JOIN he ON he.{k} = p.{k} LEFT JOIN vit v ON v.{k} = p.{k}
      LEFT JOIN ex ON ex.{k} = p.{k})
    """


AVERAGES = ("NLR_max", "OI_min", "HR_avg", "RR_avg", "SpO2_avg", "MAP_avg")


def rounded_records(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in AVERAGES})


def cohort_sql(sepsis: int) -> str:
    return (f"SELECT * FROM records WHERE seqnum = 1 AND icu_los_hours >= 24 AND sepsis_flag = {sepsis}")


@register("ward_records", records_sql() + "SELECT * FROM records")
def ward_records(s: Sample) -> DataFrame:
    return rounded_records(plan.assemble(ward_tables(s, by_stay=True)))


@register("ward_cohort_sepsis", records_sql() + cohort_sql(1))
def ward_cohort_sepsis(s: Sample) -> DataFrame:
    return rounded_records(plan.cohort(ward_tables(s, by_stay=True), sepsis=True))


@register("ward_cohort_nonsepsis", records_sql() + cohort_sql(0))
def ward_cohort_nonsepsis(s: Sample) -> DataFrame:
    return rounded_records(plan.cohort(ward_tables(s, by_stay=True), sepsis=False))


@register("ward_cultures", f"""WITH {ward_sql()}
    SELECT {STAY}, organism FROM microlab
    WHERE organism <> 'no growth' AND culturetakenoffset BETWEEN -1440 AND 1440""")
def ward_cultures(s: Sample) -> DataFrame:
    return plan.positive_cultures(ward_tables(s))


# The study's drug and care texts once more, written with plain spaces; the twins put no-break spaces in themselves.
ACETAMINOPHEN_SQL = """('20.3 ML CUP : ACETAMINOPHEN 160 MG/5ML PO SOLN'), ('ACETAMINOPHEN'), ('ACETAMINOPHEN  325 MG ORAL TAB'),
    ('ACETAMINOPHEN  500 MG ORAL TAB'), ('ACETAMINOPHEN  650 MG RECT SUPP'), ('ACETAMINOPHEN 1,000 MG/100 ML (10 MG/ML) IV SOLN'),
    ('ACETAMINOPHEN 10 MG/ML 100 ML VIAL'), ('ACETAMINOPHEN 325 MG PO TABS'), ('ACETAMINOPHEN 325 MG RECTAL SUPPOSITORY'),
    ('ACETAMINOPHEN 325 MG TABLET'), ('ACETAMINOPHEN 500 MG PO TABS'), ('ACETAMINOPHEN 650 MG RE SUPP'),
    ('ACETAMINOPHEN 650 MG RECTAL SUPPOSITORY'), ('ACETAMINOPHEN TAB'), ('Acetaminophen TAB'),
    ('HYDROCODONE 5 MG-ACETAMINOPHEN 325 MG TABLET'), ('HYDROCODONE-ACETAMINOPHEN 10-325 MG PO TABS'),
    ('HYDROCODONE-ACETAMINOPHEN 5-325 MG PO TABS'), ('HYDROcodone-acetaminophen'), ('OXYCODONE-ACETAMINOPHEN 5-325 MG PO TABS'),
    ('acetaMINOPHEN 325 MG TAB'), ('acetaMINOPHEN 650MG RECT SUPP'), ('acetaminophen'), ('acetaminophen (TYLENOL) tab 650 mg'),
    ('acetaminophen (TYLENOL) tab 975 mg'), ('acetaminophen (TYLENOL) tablet 650 mg'), ('acetaminophen 325 mg po tabs'),
    ('acetaminophen-oxyCODONE 325 mg-5 mg oral tablet'), ('oxyCODONE-acetaminophen'), ('oxycodone-acetaminophen 5-325 mg po tabs')"""
NSAID_SQL = """('IBUPROFEN'), ('KETOROLAC'), ('KETOROLAC 30 MG/ML 1ML SDV INJ'), ('KETOROLAC INJ'), ('KETOROLAC TROMETHAMINE')"""


def exposure_sql(faithful: bool) -> str:
    """Exposures by text only, with every text spelled out here."""
    same = "{0} = replace(x, ' ', chr(160))" if faithful else "replace({0}, chr(160), ' ') = x"

    def stays(table: str, column: str, offset: str, texts: str) -> str:
        return (f"SELECT {STAY} FROM {table} JOIN (VALUES {texts}) l(x) ON {same.format(column)} "
                f"WHERE {offset} BETWEEN -360 AND 1800")

    drugs = [stays("medication", "drugname", "drugstartoffset", t) for t in (ACETAMINOPHEN_SQL, NSAID_SQL)]
    care = stays("nursecare", "cellattributevalue", "nursecareoffset", "('heating/cooling blanket'), ('ice bag')")
    return f"""WITH {ward_sql()},
    found AS (SELECT {STAY}, 0 AS k FROM ({drugs[0]}) UNION ALL SELECT {STAY}, 1 FROM ({drugs[1]}) UNION ALL SELECT {STAY}, 2 FROM ({care}))
    SELECT {STAY}, count(*) FILTER (k = 0) > 0 AS acetaminophen, count(*) FILTER (k = 1) > 0 AS nsaid, count(*) FILTER (k = 2) > 0 AS cooling
    FROM found GROUP BY 1"""


def _exposures(s: Sample, faithful: bool) -> DataFrame:
    t = ward_tables(s)
    both = plan.medication_flags(t, faithful).join(plan.cooling_care(t, faithful), STAY, "full")
    names = {"acetaminophen_rx": "acetaminophen", "nsaid_rx": "nsaid", "cooling_care": "cooling"}
    return both.select(STAY, *[(F.coalesce(c, F.lit(0)) > 0).alias(n) for c, n in names.items()])


@register("ward_exposures_as_written", exposure_sql(True))
def ward_exposures_as_written(s: Sample) -> DataFrame:
    return _exposures(s, True)


@register("ward_exposures_any_space", exposure_sql(False))
def ward_exposures_any_space(s: Sample) -> DataFrame:
    return _exposures(s, False)
