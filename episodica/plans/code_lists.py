"""Fixed values of the ICU temperature study.

Code texts, drug names, sites, limits and labels. They must equal the study's
own lists, including their whitespace and spelling, so they are plain text. In the
drug names and care texts the study has no-break spaces, written ``\\u00a0`` here.
"""

from __future__ import annotations

from episodica.operators.rules import CodeRule

# --- fixed values: diagnosis codes ------------------------------------------
DIAGNOSIS_RULES = (
    CodeRule(
        "hypertension_flag",
        prefixes=(
            "cardiovascular|vascular disorders|hypertension",
            "cardiovascular|ventricular disorders|hypertension",
            "surgery|acute cardiac problems|hypertension",
        ),
        exact=(
            "cardiovascular|ventricular disorders|acute pulmonary edema|due to hypertension",
            "cardiovascular|ventricular disorders|acute pulmonary edema|due to malignant hypertension",
            "cardiovascular|ventricular disorders|cardiomyopathy|hypertrophic|hypertensive with LVH",
            "transplant|s/p kidney transplant|hypertension - kidney transplant",
        ),
    ),
    CodeRule(
        "diabetes_flag",
        prefixes=(
            "endocrine|glucose metabolism|diabetes mellitus",
            "infectious diseases|skin, bone and joint infections|diabetic foot infection",
        ),
        exact=(
            "neurologic|neuromuscular disorders|neuropathy|from diabetes",
            "renal|disorder of acid base|metabolic acidosis|ketoacidosis/diabetic",
        ),
    ),
    CodeRule(
        "CKD_flag",
        prefixes=("renal|disorder of kidney|chronic kidney disease",),
        exact=(
            "renal|disorder of kidney|chronic renal insufficiency",
            "renal|disorder of kidney|ESRD (end stage renal disease)",
        ),
    ),
    CodeRule(
        "COPD_flag",
        prefixes=(
            "pulmonary|disorders of the airways|acute COPD exacerbation",
            "pulmonary|disorders of the airways|COPD",
        ),
    ),
    CodeRule(
        "heartfailure_flag",
        prefixes=(
            "cardiovascular|ventricular disorders|congestive heart failure",
            "surgery|acute cardiac problems|congestive heart failure",
        ),
        exact=(
            "cardiovascular|shock / hypotension|sepsis|sepsis with single organ dysfunction- congestive heart failure",
            "endocrine|fluids and electrolytes|hyponatremia|due to congestive heart failure",
            "infectious diseases|systemic/other infections|sepsis|sepsis with single organ dysfunction- congestive heart failure",
            "pulmonary|disorders of vasculature|pulmonary hemorrhage|due to left sided heart failure",
            "pulmonary|pleural disorders|pleural effusion|due to heart failure",
            "renal|electrolyte imbalance|hyponatremia|due to congestive heart failure",
            "surgery|infections|sepsis|sepsis with single organ dysfunction- congestive heart failure",
        ),
    ),
    CodeRule(
        "cancer_flag",
        prefixes=(
            "endocrine|endocrine tumors",
            "gastrointestinal|post-GI surgery|s/p surgery for cancer",
            "neurologic|CNS mass lesions|brain tumor",
            "oncology|chest tumors",
            "oncology|CNS tumors",
            "oncology|GI tumors",
            "oncology|GU tumors",
            "oncology|head and neck tumors",
            "oncology|skin, muscle and skeletal tumors",
            "pulmonary|disorders of lung parenchyma|malignancy",
            "surgery|head and neck surgery|s/p head and neck cancer surgery",
        ),
        patterns=(
            "gastrointestinal|intestinal disease|GI obstruction / ileus|%|tumor",
            "gastrointestinal|intestinal disease|viscus perforation|%|due to tumor",
        ),
    ),
    CodeRule(
        "exclusion_flag",
        prefixes=(
            "burns/trauma|trauma - CNS",
            "neurologic|trauma",
            "cardiovascular|cardiac arrest|cardiac arrest",
            "infectious diseases|CNS infections",
            "neurologic|CNS mass lesions|brain abscess",
            "neurologic|infectious disease of nervous system|CNS abscess",
            "neurologic|disorders of vasculature|stroke|hemorrhagic stroke|subarachnoid hemorrhage",
            "neurologic|post-neurosurgery|post craniotomy",
        ),
        patterns=("neurologic|disorders of vasculature|%secondary to trauma",),
        exact=(
            "endocrine|fluids and electrolytes|diabetes insipidus|central|from trauma",
            "endocrine|pituitary and temperature regulation|central diabetes insipidus|from trauma",
            "neurologic|post-neurosurgery|post craniotomy|for hemorrhage",
            "neurologic|CNS mass lesions|cerebral mass of unknown etiology|likely hemorrhage",
        ),
    ),
    CodeRule(
        "septicshock_flag",
        prefixes=(
            "infectious diseases|systemic/other infections|septic shock",
            "surgery|infections|septic shock",
            "cardiovascular|shock / hypotension|septic shock",
        ),
    ),
)

# --- fixed values: treatment codes ------------------------------------------
TREATMENT_RULES = (
    CodeRule(
        "ventilation_flag",
        veto=("pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation",),
        prefixes=(
            "pulmonary|ventilation and oxygenation|CPAP/PEEP therapy",
            "pulmonary|ventilation and oxygenation|mechanical ventilation",
            "pulmonary|ventilation and oxygenation|ventilator weaning",
            "surgery|pulmonary therapies|mechanical ventilation",
            "surgery|pulmonary therapies|ventilator weaning",
            "toxicology|drug overdose|mechanical ventilation",
            "pulmonary|radiologic procedures / bronchoscopy|endotracheal tube",
            "toxicology|drug overdose|endotracheal tube",
            "pulmonary|surgery / incision and drainage of thorax|tracheostomy",
        ),
    ),
    CodeRule(
        "tracheostomy_flag",
        prefixes=("pulmonary|surgery / incision and drainage of thorax|tracheostomy",),
    ),
    CodeRule(
        "dialysis_flag",
        prefixes=("renal|dialysis",),
        patterns=("%|electrolyte correction|%|dialysis",),
    ),
    CodeRule(
        "vasopressor_flag",
        prefixes=(
            "cardiovascular|shock|vasopressors",
            "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors",
            "surgery|cardiac therapies|vasopressors",
            "toxicology|drug overdose|vasopressors",
            "surgery|cardiac therapies|inotropic agent",
        ),
        patterns=("cardiovascular|%|inotropic agent%",),
        exact=(
            "renal|electrolyte correction|treatment of hypernatremia|vasopressin",
            "gastrointestinal|medications|hormonal therapy (for varices)|vasopressin",
            "toxicology|drug overdose|agent specific therapy|beta blockers overdose|dopamine",
        ),
    ),
    CodeRule(
        "ene_less_flag",
        patterns=(
            "toxicology|drug overdose|vasopressors|%epinephrine <= 0.1 micrograms/kg/min",
            "surgery|cardiac therapies|vasopressors|%epinephrine <= 0.1 micrograms/kg/min",
            "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|%epinephrine <= 0.1 micrograms/kg/min",
            "cardiovascular|shock|vasopressors|%epinephrine <= 0.1 micrograms/kg/min",
            "cardiovascular|ventricular dysfunction|inotropic agent|%epinephrine <= 0.1 micrograms/kg/min",
            "cardiovascular|shock|inotropic agent|%epinephrine <= 0.1 micrograms/kg/min",
            "cardiovascular|myocardial ischemia / infarction|inotropic agent|%epinephrine <= 0.1 micrograms/kg/min",
        ),
    ),
    CodeRule(
        "ene_over_flag",
        patterns=(
            "toxicology|drug overdose|vasopressors|%epinephrine > 0.1 micrograms/kg/min",
            "surgery|cardiac therapies|vasopressors|%epinephrine > 0.1 micrograms/kg/min",
            "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|%epinephrine > 0.1 micrograms/kg/min",
            "cardiovascular|shock|vasopressors|%epinephrine > 0.1 micrograms/kg/min",
            "cardiovascular|ventricular dysfunction|inotropic agent|%epinephrine > 0.1 micrograms/kg/min",
            "cardiovascular|shock|inotropic agent|%epinephrine > 0.1 micrograms/kg/min",
            "cardiovascular|myocardial ischemia / infarction|inotropic agent|%epinephrine > 0.1 micrograms/kg/min",
        ),
    ),
    CodeRule(
        "dop_less5_flag",
        exact=(
            "cardiovascular|shock|inotropic agent|dopamine <= 5 micrograms/kg/min",
            "surgery|cardiac therapies|inotropic agent|dopamine <= 5 micrograms/kg/min",
            "cardiovascular|ventricular dysfunction|inotropic agent|dopamine <= 5 micrograms/kg/min",
            "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine <= 5 micrograms/kg/min",
        ),
    ),
    CodeRule(
        "dop_5to15_flag",
        exact=(
            "toxicology|drug overdose|vasopressors|dopamine 5-15 micrograms/kg/min",
            "surgery|cardiac therapies|vasopressors|dopamine  5-15 micrograms/kg/min",
            "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|dopamine 5-15 micrograms/kg/min",
            "cardiovascular|shock|vasopressors|dopamine  5-15 micrograms/kg/min",
            "cardiovascular|shock|inotropic agent|dopamine  5-15 micrograms/kg/min",
            "surgery|cardiac therapies|inotropic agent|dopamine  5-15 micrograms/kg/min",
            "cardiovascular|ventricular dysfunction|inotropic agent|dopamine  5-15 micrograms/kg/min",
            "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine  5-15 micrograms/kg/min",
        ),
    ),
    CodeRule(
        "dop_over15_flag",
        exact=(
            "toxicology|drug overdose|vasopressors|dopamine >15 micrograms/kg/min",
            "surgery|cardiac therapies|vasopressors|dopamine >15 micrograms/kg/min",
            "neurologic|therapy for controlling cerebral perfusion pressure|vasopressors|dopamine > 15 micrograms/kg/min",
            "cardiovascular|shock|vasopressors|dopamine >15 micrograms/kg/min",
            "cardiovascular|shock|inotropic agent|dopamine >15 micrograms/kg/min",
            "surgery|cardiac therapies|inotropic agent|dopamine >15 micrograms/kg/min",
            "cardiovascular|ventricular dysfunction|inotropic agent|dopamine >15 micrograms/kg/min",
            "cardiovascular|myocardial ischemia / infarction|inotropic agent|dopamine >15 micrograms/kg/min",
        ),
    ),
    CodeRule(
        "antibiotics_flag",
        prefixes=(
            "cardiovascular|other therapies|antibacterials",
            "infectious diseases|medications|prophylactic antibacterials",
            "infectious diseases|medications|therapeutic antibacterials",
            "pulmonary|medications|antibacterials",
            "pulmonary|medications|antifungal therapy",
            "renal|medications|antibacterials",
            "surgery|infection|prophylactic antibacterials",
            "surgery|infection|therapeutic antibacterials",
            "surgery|infection|antifungal therapy",
            "infectious diseases|medications|antifungal therapy",
            "renal|medications|antifungal therapy",
            "renal|medications|systemic antibiotics",
            "gastrointestinal|medications|antibiotics",
        ),
    ),
)

# --- fixed values: antipyretic and cooling exposure -------------------------
ACETAMINOPHEN_DRUGS = (
    "20.3\u00a0ML\u00a0CUP\u00a0:\u00a0ACETAMINOPHEN\u00a0160\u00a0MG/5ML\u00a0PO\u00a0SOLN",
    "ACETAMINOPHEN",
    "ACETAMINOPHEN\u00a0\u00a0325\u00a0MG\u00a0ORAL\u00a0TAB",
    "ACETAMINOPHEN\u00a0\u00a0500\u00a0MG\u00a0ORAL\u00a0TAB",
    "ACETAMINOPHEN\u00a0\u00a0650\u00a0MG\u00a0RECT\u00a0SUPP",
    "ACETAMINOPHEN\u00a01,000\u00a0MG/100\u00a0ML\u00a0(10\u00a0MG/ML)\u00a0IV\u00a0SOLN",
    "ACETAMINOPHEN\u00a010\u00a0MG/ML\u00a0100\u00a0ML\u00a0VIAL",
    "ACETAMINOPHEN\u00a0325\u00a0MG\u00a0PO\u00a0TABS",
    "ACETAMINOPHEN\u00a0325\u00a0MG\u00a0RECTAL\u00a0SUPPOSITORY",
    "ACETAMINOPHEN\u00a0325\u00a0MG\u00a0TABLET",
    "ACETAMINOPHEN\u00a0500\u00a0MG\u00a0PO\u00a0TABS",
    "ACETAMINOPHEN\u00a0650\u00a0MG\u00a0RE\u00a0SUPP",
    "ACETAMINOPHEN\u00a0650\u00a0MG\u00a0RECTAL\u00a0SUPPOSITORY",
    "ACETAMINOPHEN\u00a0TAB",
    "Acetaminophen\u00a0TAB",
    "HYDROCODONE\u00a05\u00a0MG-ACETAMINOPHEN\u00a0325\u00a0MG\u00a0TABLET",
    "HYDROCODONE-ACETAMINOPHEN\u00a010-325\u00a0MG\u00a0PO\u00a0TABS",
    "HYDROCODONE-ACETAMINOPHEN\u00a05-325\u00a0MG\u00a0PO\u00a0TABS",
    "HYDROcodone-acetaminophen",
    "OXYCODONE-ACETAMINOPHEN\u00a05-325\u00a0MG\u00a0PO\u00a0TABS",
    "acetaMINOPHEN\u00a0325\u00a0MG\u00a0TAB",
    "acetaMINOPHEN\u00a0650MG\u00a0RECT\u00a0SUPP",
    "acetaminophen",
    "acetaminophen\u00a0(TYLENOL)\u00a0tab\u00a0650\u00a0mg",
    "acetaminophen\u00a0(TYLENOL)\u00a0tab\u00a0975\u00a0mg",
    "acetaminophen\u00a0(TYLENOL)\u00a0tablet\u00a0650\u00a0mg",
    "acetaminophen\u00a0325\u00a0mg\u00a0po\u00a0tabs",
    "acetaminophen-oxyCODONE\u00a0325\u00a0mg-5\u00a0mg\u00a0oral\u00a0tablet",
    "oxyCODONE-acetaminophen",
    "oxycodone-acetaminophen\u00a05-325\u00a0mg\u00a0po\u00a0tabs",
)
ACETAMINOPHEN_TREATMENTS = ("surgery|wounds / temperature|antipyretics|acetaminophen",)
NSAID_DRUGS = (
    "IBUPROFEN",
    "KETOROLAC",
    "KETOROLAC\u00a030\u00a0MG/ML\u00a01ML\u00a0SDV\u00a0INJ",
    "KETOROLAC\u00a0INJ",
    "KETOROLAC\u00a0TROMETHAMINE",
)
NSAID_TREATMENTS = ("surgery|wounds / temperature|antipyretics|NSAID",)
COOLING_CARE = ("heating/cooling\u00a0blanket", "ice\u00a0bag")
COOLING_TREATMENTS = (
    "endocrine|pituitary and temperature regulation|treatment for hyperthermia|external cooling",
    "surgery|wounds / temperature|cooling the patient",
    "surgery|wounds / temperature|cooling the patient|external cooling",
    "endocrine|pituitary and temperature regulation|treatment for hyperthermia|evaporative cooling",
)

# --- fixed values: laboratory names and plausible ranges --------------------
# Values outside the inclusive range become NULL. The AST rows are selected by
# one name and the AST range is stated for another, so it never applies.
LAB_LIMITS = {
    "WBC x 1000": (0, 1000),
    "-polys": (0, 100),
    "-lymphs": (0, 100),
    "Hgb": (0, 50),
    "Hct": (0, 100),
    "platelets x 1000": (0, 10000),
    "lactate": (0.1, 30),
    "ALT (SGPT)": (0, 2000),
    "AST (SGOT)": (0, 2000),
    "total bilirubin": (0.2, 100),
    "BUN": (1, 300),
    "creatinine": (1, 100),
}
AST_SELECTED = "AST (SGPT)"
AST_INTENDED = "AST (SGOT)"

# --- fixed values: other ----------------------------------------------------
NO_GROWTH = "no growth"
CORE_SITES = ("Vascular", "Esophageal", "Core", "Bladder")
ROOM_AIR_FIO2 = 21
MIN_SOFA = 2
MIN_ICU_HOURS = 24

# --- fixed values: cleaning -------------------------------------------------
TOP_CODED_AGE = {"> 89": "91.5"}
HEIGHT_CM = (50, 300)
WEIGHT_KG = (20, 600)
BMI_RANGE = (15, 100)
CARDIAC_UNITS = ("Cardiac ICU", "CSICU", "CTICU", "CCU-CTICU")
CARDIAC_UNIT = "Cardiac ICU"
OTHER_ETHNICITY_MEMBERS = ("Native American", "")
OTHER_ETHNICITY = "Other/Unknown"
NON_REGION_ETHNICITY = ("Other/Unknown", "African American", "Asian", "Caucasian")
REGION_ETHNICITY = ("Hispanic",)
TEMPERATURE_BREAKS = (36, 37.2, 38.3, 39)
TEMPERATURE_CLASSES = ("< 36", "36 ~ 37.1", "37.2 ~ 38.2", "38.3 ~ 38.9", ">= 39")
REFERENCE_CLASS = "36 ~ 37.1"
SEXES = ("Female", "Male")
FEVER_CLASSES = ("38.3 ~ 38.9", ">= 39")
ADULT_AGE = 18
RISK_TABLE_DAYS = (0, 7, 14, 21, 28)

# --- fixed values: display labels -------------------------------------------
DISPLAY_LABELS = {
    "age_trans": "Age, years",
    "gender_trans": "Male, %",
    "BMI": "BMI, kg/m2",
    "race": "Ethnicity, %",
    "ICU": "Admitted ICU type, %",
    "region": "Region, %",
    "apache_iv": "APACHE IV score",
    "sofa": "SOFA score",
    "hypertension_flag": "Hypertension, %",
    "diabetes_flag": "Diabetes mellitus, %",
    "CKD_flag": "CKD, %",
    "COPD_flag": "COPD, %",
    "heartfailure_flag": "Congestive heart failure, %",
    "cancer_flag": "Cancer, %",
    "ventilation_flag": "Mechanical Ventilation, %",
    "tracheostomy_flag": "Tracheostomy, %",
    "dialysis_flag": "Dialysis, %",
    "vasopressor_flag": "Vasopressor, %",
    "ene_less_flag": "(Nor)epinephrine <= 0.1 micrograms/kg/min, %",
    "ene_over_flag": "(Nor)epinephrine > 0.1 micrograms/kg/min, %",
    "dop_over5_flag": "Dopamine > 5 micrograms/kg/min, %",
    "dop_less5_flag": "Dopamine <= 5 micrograms/kg/min, %",
    "antibiotics_flag": "Antibiotics, %",
    "hosp_mortality": "In-hospital mortality, %",
    "icu_mortality": "ICU mortality, %",
    "hosp_los_hours": "Hospital LOS, hours",
    "icu_los_hours": "ICU LOS, hours",
    "HR_max": "Max heart rate, bpm",
    "RR_max": "Max respiratory rate, bpm",
    "SpO2_min": "Min SPO2, %",
    "MAP_min": "Min MAP, mmHg",
    "T_max": "Tmax",
    "T_max_peri": "Tmax",
    "comorbidites_flag": "Comorbidities, %",
    "WBC_max": "Max WBC, 10^9/L",
    "HGB_min": "Min hemoglobin, g/L",
    "HCT_min": "Min hemocrit, %",
    "PLT_min": "Min platelet, 10^9/L",
    "LAC_max": "Max lactate, mmol/L",
    "ALT_max": "Max ALT, U/L",
    "AST_max": "Max AST, U/L",
    "BIL_max": "Max total bilirubin, mg/dL",
    "BUN_max": "Max BUN, mg/dL",
    "SCR_max": "Max cretitine, mg/dL",
    "NLR_max": "Max NLR",
    "uo_24h": "Urine output, mL",
    "OI_min": "Min OI, mmHg",
    "septicshock_flag": "Septic shock, %",
    "acetaminophen_flag": "Acetaminophen, %",
    "nsaid_flag": "NSAIDs, %",
}
