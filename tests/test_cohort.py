"""Hand-made rows for the rules of the cohort that are easy to get wrong."""

import random

import pytest

from episodica.operators import factors
from episodica.operators.clean import adult_first_visits, clean
from episodica.plans import code_lists as fixed
from episodica.plans import cohort as plan
from episodica.plans import study
from episodica.sources.stages import StageStore
from episodica.sources.tables import CLINICAL_SCHEMAS

DAY = 1440


def tables(spark, **rows):
    """All clinical tables; those not given are empty."""
    return {
        name: spark.createDataFrame(rows.get(name, []), ddl) for name, ddl in CLINICAL_SCHEMAS.items()
    }


def patient(person, stay, los_hours=48, age="60", gender="Male", visit=1, hospital_stay=None):
    return (person, hospital_stay or stay, stay, visit, 1, "MICU", 0, los_hours * 60, los_hours * 60, 2015, age,
            "dx", "Alive", "Alive", gender, "Asian", 170.0, 70.0)


def vital(stay, offset, temp=None, place="Oral", ibp=None, nibp=None, hr=80.0):
    return (stay, offset, hr, 16.0, 97.0, ibp, nibp, temp, place)


SITES = [("Oral", "Oral"), ("BL", "Bladder"), ("ODD", None)]


def by_stay(df):
    return {r.patientunitstayid: r for r in df.collect()}


def test_culture_text_and_window(spark):
    t = tables(spark, microlab=[
        (1, "no growth", 0), (2, "No Growth", 0), (3, None, 0), (4, "E. coli", -DAY - 1), (5, "E. coli", -DAY),
        (6, "E. coli", DAY), (7, "E. coli", DAY + 1),
    ])
    assert sorted(r[0] for r in plan.positive_cultures(t).collect()) == [2, 5, 6]


def test_culture_alone_does_not_qualify(spark):
    t = tables(
        spark,
        microlab=[(1, "E. coli", 0)],
        diagnosis=[(2, "sepsis", 0), (3, "sepsis", 2000), (4, "sepsis", 0), (4, "sepsis", 5), (5, "other", 0)],
        infection_diagnosis=[("sepsis",)],
        sofascore=[(1, 5), (2, 2), (3, 5), (4, 9), (5, 9)],
    )
    assert {r.patientunitstayid: r.sofa for r in plan.infection_cohort(t).collect()} == {2: 2, 4: 9}


def test_lab_rules(spark):
    t = tables(spark, lab=[
        (1, "Hgb", 7.0, 10), (1, "Hgb", 12.0, 20), (1, "Hgb", 51.0, 30),
        (1, "AST (SGPT)", 5000.0, 0), (1, "AST (SGOT)", 40.0, 0),
        (1, "creatinine", 0.8, 5), (1, "BUN", 0.9, 5), (1, "lactate", 0.1, DAY), (1, "lactate", 9.0, DAY + 1),
        (1, "lactate", 8.0, -1), (2, "-polys", 80.0, 1), (2, "-lymphs", 10.0, 1), (3, "-polys", 80.0, 1),
        (3, "-lymphs", 0.0, 1),
    ])
    rows = by_stay(plan.lab_extremes(t))
    assert (rows[1].HGB_min, rows[1].AST_max, rows[1].SCR_max, rows[1].BUN_max, rows[1].LAC_max) == (
        12.0, 5000.0, None, None, 0.1)
    assert rows[2].NLR_max == 8.0 and rows[3].NLR_max is None
    intended = by_stay(plan.lab_extremes(t, faithful=False))
    assert (intended[1].HGB_min, intended[1].AST_max) == (7.0, 40.0)


def test_oxygenation_and_pressure(spark):
    t = tables(
        spark,
        pivoted_bg=[(1, 0, 84.0, 0.0), (1, 5, 90.0, 10.0), (2, 0, None, 21.0), (3, 2000, 50.0, 50.0)],
        pivoted_vital=[
            vital(1, 10, ibp=80.0), vital(1, 5000, ibp=40.0), vital(1, 5000, nibp=20.0), vital(1, 20, nibp=60.0),
            vital(2, 3000, ibp=50.0), vital(3, 0),
        ],
    )
    assert {k: r.OI_min for k, r in by_stay(plan.oxygenation(t)).items()} == {1: 4.0}
    v = by_stay(plan.vital_summary(t))
    assert set(v) == {1, 3}
    assert (v[1].MAP_min, v[1].MAP_avg, v[3].MAP_min) == (40.0, 60.0, None)
    assert by_stay(plan.vital_summary(t, faithful=False))[1].MAP_min == 60.0
    series = sorted(r.MAP for r in plan.pressure_series(t).collect())
    assert series == [40.0, 50.0, 60.0, 80.0]


def test_temperature_sites(spark):
    t = tables(spark, tempsite=SITES, pivoted_vital=[
        vital(1, 0, 38.0, "Oral"), vital(1, 5, 39.5, "BL"), vital(1, 6, 35.0, "ODD"), vital(1, 7, 42.0, "NOWHERE"),
        vital(1, DAY + 1, 43.0, "BL"), vital(2, 0, 37.0, "ODD"),
    ])
    rows = by_stay(plan.temperature_extremes(t))
    assert (rows[1].T_max, rows[1].T_min) == (39.5, 35.0)
    assert (rows[1].T_max_core, rows[1].tmax_core, rows[1].T_max_peri, rows[1].tmax_peri) == (39.5, "Bladder", 38.0, "Oral")
    assert (rows[1].T_min_peri, rows[1].tmin_peri, rows[1].t_core_flag) == (35.0, None, 1)
    assert (rows[2].T_max_peri, rows[2].t_peri_flag, rows[2].t_core_flag) == (37.0, 1, 0)


def test_rule_flags(spark):
    quiet = "pulmonary|ventilation and oxygenation|mechanical ventilation|non-invasive ventilation"
    loud = "pulmonary|ventilation and oxygenation|mechanical ventilation|volume control"
    t = tables(
        spark,
        patient=[patient(f"p{i}", i) for i in range(1, 8)],
        treatment=[
            (1, quiet, 0), (2, quiet, 0), (2, loud, 0),
            (3, "cardiovascular|shock|vasopressors|dopamine  5-15 micrograms/kg/min", 0),
            (4, "cardiovascular|shock|vasopressors|dopamine 5-15 micrograms/kg/min", 0),
            (5, "cardiovascular|shock|vasopressors|norepinephrine <= 0.1 micrograms/kg/min", 9999),
            (6, "surgery|wounds / temperature|antipyretics|NSAID", 1801),
            (7, "surgery|wounds / temperature|antipyretics|NSAID", 1800),
        ],
        medication=[(1, "ACETAMINOPHEN", -361), (2, "ACETAMINOPHEN", -360), (3, "Acetaminophen", 0)],
        nursecare=[(4, 0, "ice\u00a0bag"), (5, 0, "Ice\u00a0Bag"), (6, 0, "ice bag")],
    )
    rows = by_stay(plan.interventions_and_exposures(t))
    assert {k: r.ventilation_flag for k, r in rows.items() if k < 4} == {1: 0, 2: 1, 3: 0}
    assert (rows[3].dop_5to15_flag, rows[4].dop_5to15_flag) == (1, 0)
    assert (rows[5].ene_less_flag, rows[5].vasopressor_flag) == (1, 1)
    assert (rows[6].nsaid_flag, rows[7].nsaid_flag) == (0, 1)
    assert [rows[i].acetaminophen_flag for i in (1, 2, 3)] == [0, 1, 0]
    assert [rows[i].cooling_flag for i in (4, 5, 6)] == [1, 0, 0]
    flags = by_stay(plan.comorbidities(t))
    assert len(flags) == 7 and all(v == 0 for v in flags[1][1:])


@pytest.fixture(scope="module")
def small_ward(spark):
    return tables(
        spark,
        patient=[
            patient("a", 1, los_hours=10), patient("a", 2, los_hours=40),
            patient("b", 4, los_hours=30), patient("b", 3, los_hours=30),
            patient("c", 5), patient("c", 6), patient("d", 7),
        ],
        pivoted_vital=[vital(i, 0, 37.0) for i in (1, 2, 3, 4, 5, 6)] + [vital(7, 0)],
        tempsite=SITES,
        diagnosis=[(5, "neurologic|trauma - brain", 0), (3, "sepsis", 0)],
        infection_diagnosis=[("sepsis",)],
        sofascore=[(3, 4)],
        apachepatientresult=[(3, 50.0), (3, 70.0)],
        hospital=[(1, "South")],
    )


def test_first_stay_is_chosen_before_the_filters(small_ward):
    sepsis = by_stay(plan.cohort(small_ward, sepsis=True))
    others = by_stay(plan.cohort(small_ward, sepsis=False))
    # a: the first stay is too short and no later one steps in; c: stay 5 is excluded, so 6 is first.
    assert set(sepsis) == {3} and set(others) == {6}
    assert (sepsis[3].apache_iv, sepsis[3].region, sepsis[3].sofa) == (70.0, "South", 4)


def test_record_layout(small_ward):
    records = plan.assemble(small_ward)
    assert tuple(records.columns) == plan.COHORT_COLUMNS and len(records.columns) == 84
    assert {(r.patientunitstayid, r.seqnum) for r in records.collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (6, 1)}


def test_records_from_bucketed_stages(spark, small_ward, tmp_path):
    want = sorted(map(str, plan.assemble(small_ward).collect()))
    store = StageStore(spark, str(tmp_path), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = plan.assemble(small_ward, store=store, inputs="ward 1")
        assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, records.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # nothing is built again for the same inputs: no table is needed any more
    assert sorted(map(str, plan.assemble({}, store=store, inputs="ward 1").collect())) == want
    with pytest.raises(KeyError):
        plan.assemble({}, store=store, inputs="ward 2")
    both = study.frames(small_ward), study.frames(small_ward, store=store, inputs="ward 1")
    for name in ("sepsis", "nonsepsis"):
        plain, kept = (getattr(f, name) for f in both)
        assert sorted(map(str, plain.collect())) == sorted(map(str, kept.collect()))
        assert factors.levels_of(kept, "T_class") == list(fixed.TEMPERATURE_CLASSES)


def test_cleaning(spark):
    t = tables(
        spark,
        patient=[
            patient("a", 1, age="> 89"), patient("b", 2, age="abc"), patient("c", 3, age=None), patient("d", 4, age="17"),
            patient("e", 5, age="18"), patient("f", 6, gender="Unknown"), patient("g", 7, visit=2),
        ],
        pivoted_vital=[vital(1, 0, 35.9), vital(4, 0, 36.0), vital(5, 0, 38.3), vital(7, 0, 39.0),
                       vital(2, 0, 37.0), vital(3, 0, 37.0), vital(6, 0, 37.0)],
        tempsite=SITES,
    )
    rows = by_stay(clean(plan.assemble(t)))
    assert set(rows) == {1, 4, 5, 7}
    assert (rows[1].age_trans, rows[1].gender_trans, round(rows[1].BMI, 4)) == (91.5, "Male", 24.2215)
    assert [rows[i].T_class for i in (1, 4, 5, 7)] == ["< 36", "36 ~ 37.1", "38.3 ~ 38.9", ">= 39"]
    assert set(by_stay(adult_first_visits(clean(plan.assemble(t))))) == {1, 5}


@pytest.mark.parametrize("faithful", [True, False])
def test_vitals_in_two_levels_equal_two_passes(spark, faithful):
    rnd = random.Random(11)
    maybe = lambda lo, hi: None if rnd.random() < 0.3 else float(rnd.randrange(lo, hi))
    rows = [
        (rnd.randrange(25), rnd.randrange(-300, 3000), maybe(40, 150), maybe(8, 40), maybe(70, 100), maybe(40, 110), maybe(40, 110), maybe(34, 42),
         rnd.choice(["axillary", "rectal", "oral", "twice", "unknown", "unlisted", None]))
        for _ in range(900)
    ]
    sites = [("axillary", "Axillary"), ("rectal", "Core"), ("oral", "Oral"), ("twice", "Bladder"), ("twice", "Oral"), ("twice", None), ("unknown", None), (None, "Core")]
    t = {
        "pivoted_vital": spark.createDataFrame(rows, CLINICAL_SCHEMAS["pivoted_vital"]),
        "tempsite": spark.createDataFrame(sites, CLINICAL_SCHEMAS["tempsite"]),
    }
    once = plan.vital_record(t, faithful)
    twice = plan.temperature_extremes(t).join(plan.vital_summary(t, faithful), plan.STAY)
    assert set(once.columns) == set(twice.columns) and once.count() > 20
    columns = sorted(once.columns)
    close = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert close(once.select(columns).collect()) == close(twice.select(columns).collect())
