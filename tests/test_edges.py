"""Cases outside the sample tables: texts as written, NaN, blanks, wildcards, empty cells, large numbers of rules."""

import math

import pytest
from pyspark.sql import functions as F

from episodica.catalog.ward import ACETAMINOPHEN_SQL, NSAID_SQL
from episodica.functions.pvalues import chi2_tail, t_two_sided
from episodica.operators.rules import CodeRule, Source, event_flags, event_flags_by_dictionary, exposure_flags
from episodica.operators.summary import categorical_table
from episodica.plans import code_lists as fixed
from episodica.plans import cohort as plan
from episodica.sources.tables import CLINICAL_SCHEMAS, load_clinical, read_csv

NB = "\u00a0"


def test_drug_texts_have_no_break_spaces():
    plain = [x.replace(NB, " ") for x in fixed.ACETAMINOPHEN_DRUGS]
    assert len(plain) == 30 and not any(" " in x for x in fixed.ACETAMINOPHEN_DRUGS)
    assert all(f"('{x}')" in ACETAMINOPHEN_SQL for x in plain) and ACETAMINOPHEN_SQL.count("('") == 30
    assert all(f"('{x.replace(NB, ' ')}')" in NSAID_SQL for x in fixed.NSAID_DRUGS) and NSAID_SQL.count("('") == 5
    assert fixed.COOLING_CARE == (f"heating/cooling{NB}blanket", f"ice{NB}bag")


@pytest.mark.parametrize("faithful,stays", [(True, {1}), (False, {1, 2})])
def test_spaces_of_drug_texts(spark, faithful, stays):
    rows = [(1, f"KETOROLAC{NB}INJ", 0), (2, "KETOROLAC INJ", 0), (3, "KETOROLACINJ", 0)]
    t = {"medication": spark.createDataFrame(rows, "patientunitstayid bigint, drugname string, drugstartoffset bigint")}
    assert {r[0] for r in plan.medication_flags(t, faithful).collect()} == stays


def test_chi_square_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-12)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-12)
    assert chi2_tail(1074.679449, 1000) == pytest.approx(0.05, rel=1e-6)
    # around the mean the tail is 1/2 - 1 / (3 sqrt(pi df)) up to smaller terms
    for df in (1480, 1491, 1600, 10**5):
        assert chi2_tail(df, df) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * df)), abs=2e-5)
    assert chi2_tail(2000, 1000) < 1e-60 and chi2_tail(0, 3) == 1.0


def test_t_tail_with_many_degrees_of_freedom():
    normal = math.erfc(1 / math.sqrt(2))
    assert t_two_sided(1.0, 1e10) == pytest.approx(normal, rel=1e-9)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-8)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)


def test_nan_is_unknown_on_ingest(spark):
    lab = spark.createDataFrame([(1, "x", float("nan"), 0), (1, "x", 2.0, 0)], "patientunitstayid bigint, labname string, labresult double, labresultoffset bigint")
    empty = {n: spark.createDataFrame([], d) for n, d in CLINICAL_SCHEMAS.items()}
    t = load_clinical(spark, "none", {**empty, "lab": lab})
    assert t["lab"].agg({"labresult": "max"}).first()[0] == 2.0


def test_blank_text_in_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,ethnicity,n\n1,,\n2,NA,NA\n3,"",3\n4,Asian,4\n')
    rows = read_csv(spark, f"{tmp_path}/a.csv", "id int, ethnicity string, n int").orderBy("id").collect()
    assert [(r.ethnicity, r.n) for r in rows] == [("", None), (None, None), ("", 3), ("Asian", 4)]


def test_like_wildcards(spark):
    events = spark.createDataFrame([(1, "abc|x|d"), (2, "ac|x|d"), (3, "exact"), (4, "a%c")], "k int, code string")
    rules = [CodeRule("under", patterns=("a_c|%|d",)), CodeRule("plain", patterns=("exact",)), CodeRule("escaped", patterns=("a\\%c",))]
    got = {r[0]: tuple(r[1:]) for r in event_flags(events, "k", "code", rules).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 0, 0), 3: (0, 1, 0), 4: (0, 0, 1)}


def test_more_rules_than_a_mask_holds(spark):
    events = spark.createDataFrame([(i % 7, f"code{i}") for i in range(80)], "k int, code string")
    rules = [CodeRule(f"f{i}", exact=(f"code{i}",)) for i in range(80)]
    for flags in (event_flags, event_flags_by_dictionary):
        for r in flags(events, "k", "code", rules).collect():
            assert [r[f"f{i}"] for i in range(80)] == [int(i % 7 == r["k"]) for i in range(80)]


def test_every_level_in_every_stratum(spark):
    rows = [("a", "x"), ("a", None), ("b", None), ("b", None), ("c", "y"), (None, "z")]
    table = categorical_table(spark.createDataFrame(rows, "g string, v string"), "g", ["v"])
    got = {(r.stratum, r.level): (r.n, r.pct, r.missing) for r in table.collect()}
    assert got == {("a", "x"): (1, 100.0, 1), ("a", "y"): (0, 0.0, 1), ("b", "x"): (0, None, 2), ("b", "y"): (0, None, 2),
                   ("c", "x"): (0, 0.0, 0), ("c", "y"): (1, 100.0, 0), ("Total", "x"): (1, 50.0, 3), ("Total", "y"): (1, 50.0, 3)}


def test_exposures_of_one_table_share_its_scan(spark, tmp_path):
    spark.createDataFrame([(k % 7, k, "x" if k % 3 else None) for k in range(60)], "stay long, v long, c string").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "stay long, v long").write.parquet(f"{tmp_path}/o")
    events, other = spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/o")
    base = spark.createDataFrame([(k,) for k in range(9)], "stay long")
    asked = {f"f{i}": [Source(events, F.col("v") == i)] for i in range(70)}
    asked |= {"c": [Source(events, (F.col("c") == "x") & (F.col("v") > 50)), other.where("v = 1")], "all": [events]}
    found = exposure_flags(base, "stay", asked)
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan parquet") == 2
    rows = {r["stay"]: r for r in found.collect()}
    for k in range(9):
        for i in range(70):
            assert rows[k][f"f{i}"] == (i < 60 and i % 7 == k)
        assert rows[k]["c"] == (k == 3 or any(v % 7 == k and v % 3 for v in range(51, 60))) and rows[k]["all"] == (k < 7)


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    lines = ["id,whole,real,late,mixed,flag,empty,quoted"]
    lines += [f"{i},{'NA' if i % 5 == 0 else i * 10**9},{i}.5e-1,{i},{'' if i % 3 else i},TRUE,NA,\"a,{i}\"" for i in range(400)]
    lines += ["400,7,,late text,1.25,FALSE,,\"\"", "401,-3,NA,,NA,NA,,NA"]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    found = read_csv(spark, str(tmp_path / "x.csv"))
    assert dict(found.dtypes) == {
        "id": "bigint", "whole": "bigint", "real": "double", "late": "string", "mixed": "double", "flag": "boolean", "empty": "double", "quoted": "string"}
    stated = read_csv(spark, str(tmp_path / "x.csv"), found.schema)
    assert sorted(map(str, found.collect())) == sorted(map(str, stated.collect()))
    last = found.where("id = 401").first()
    assert (last.whole, last.real, last.late, last.mixed, last.flag, last.empty, last.quoted) == (-3, None, "", None, None, None, None)
    assert found.where("id = 400").first().late == "late text"


def test_numbers_too_long_for_a_long_are_doubles(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n9223372036854775807,99999999999999999999,1_000,+5\n1,2,3,4.\n")
    assert dict(read_csv(spark, str(tmp_path / "x.csv")).dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "double"}
    (tmp_path / "y.csv").write_text("a,b\n")
    assert dict(read_csv(spark, str(tmp_path / "y.csv")).dtypes) == {"a": "double", "b": "double"}
