import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.operators import code_index, factors
from episodica.operators.code_index import code_rules, event_flags_by_index, raised_flags
from episodica.operators.rules import CodeRule, event_flags_by_dictionary
from episodica.operators.summary import categorical_table
from episodica.sources.tables import read_dataset, write_dataset


def like(pattern, text):
    """LIKE with a backslash as escape, character by character."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(out, text, re.S) is not None


def raises(rule, code):
    if any(code.startswith(v) for v in rule.veto):
        return False
    return any(code.startswith(p) for p in rule.prefixes) or code in rule.exact or any(like(p, code) for p in rule.patterns)


PATTERNS = ["a%", "%a", "%", "%%", "_", "a_", "_a", "a|%|b%", "%|b|%", "a%a", "aa%aa", r"a\%%", r"%\_", "a|b", "", "%a%", "a%%", "%%a", "_%", "%_", r"a\_%", "a|_|%b"]


def test_every_shape_equals_brute_force(spark):
    rng = random.Random(3)
    codes = {"".join(rng.choice("ab|%_") for _ in range(rng.randrange(0, 7))) for _ in range(800)} | {"aa", "aaa", "aaaa", "a|b", "ä|b", "a|😀|b"}
    rules = [CodeRule(f"p{k}", patterns=(p,)) for k, p in enumerate(PATTERNS)]
    rules += [CodeRule("pre", prefixes=("a|", "a|b"), veto=("a|ba",)), CodeRule("ex", exact=("a|b", "")), CodeRule("veto", veto=("a",)), CodeRule("none"),
              CodeRule("all", prefixes=("",)), CodeRule("mix", prefixes=("b",), patterns=("%|b",), exact=("ab",), veto=("b|",))]
    df = spark.createDataFrame([(k, c) for k, c in enumerate([*sorted(codes), None, "aa"])], "stay int, code string")
    got = {(r.code, r.rule) for r in code_rules(df, "code", rules).collect()}
    assert got == {(c, k) for c in codes for k, r in enumerate(rules) if raises(r, c)}


def test_wide_and_long_forms_agree_beyond_one_mask(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: "|".join(rng.choice("abcd") + str(rng.randrange(6)) for _ in range(3))
    events = spark.createDataFrame([(rng.randrange(60), text()) for _ in range(900)] + [(99, None), (98, "zzz")], "stay int, code string")
    rules = [CodeRule(f"f{k}", prefixes=(text()[: rng.randrange(2, 8)],), patterns=(text()[:2] + "|%|" + text()[-2:],)) for k in range(130)]
    want = {r.stay: r.asDict() for r in event_flags_by_dictionary(events, "stay", "code", rules).collect()}
    wide = {r.stay: r.asDict() for r in event_flags_by_index(events, "stay", "code", rules).collect()}
    assert wide == want and 99 not in wide
    long = {(r.stay, r.flag) for r in raised_flags(events, "stay", "code", rules).collect()}
    assert long == {(k, f) for k, row in want.items() for f, v in row.items() if f != "stay" and v}
    monkeypatch.setattr(code_index, "BROADCAST_ENTRIES", 0)
    assert {(r.stay, r.flag) for r in raised_flags(events, "stay", "code", rules).collect()} == long


def test_a_code_meets_only_entries_with_its_own_text(spark):
    rules = [CodeRule(f"f{k}", prefixes=(f"a|{k:04d}",)) for k in range(5000)]
    df = spark.createDataFrame([(k, f"a|{k * 7:04d}|x") for k in range(500)], "stay int, code string")
    found = code_rules(df, "code", rules)
    assert found.count() == 500
    assert len({len(e[2]) for e in code_index.entries(rules)}) == 1
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_rules_and_no_events(spark):
    empty = spark.createDataFrame([], "stay int, code string")
    assert raised_flags(empty, "stay", "code", [CodeRule("a", prefixes=("a",))]).count() == 0
    some = spark.createDataFrame([(1, "a")], "stay int, code string")
    assert raised_flags(some, "stay", "code", [CodeRule("a")]).count() == 0
    assert raised_flags(some, "stay", "code", []).count() == 0


ROWS = [(1, "warm", 1), (2, "cold", 1), (3, "odd", 0), (4, None, 0), (5, "hot", 1), (6, "cold", 0)]
ORDER = ["cold", "warm", "hot", "never"]


@pytest.fixture()
def frame(spark):
    return factors.as_factor(spark.createDataFrame(ROWS, "id int, t string, y int"), "t", ORDER, {"hot": "Very hot"})


def test_levels_travel_with_the_frame(spark, frame, tmp_path):
    later = frame.where("id > 0").select("id", "t").join(frame.select("id", "y"), "id").withColumn("z", F.lit(1))
    kept = write_dataset(frame, str(tmp_path / "stage"))
    for df in (frame, later, kept, read_dataset(spark, str(tmp_path / "stage")), frame.unionByName(frame)):
        assert factors.levels_of(df, "t") == ORDER and factors.labels_of(df, "t")["hot"] == "Very hot"
        got = {(r.id, r.o) for r in df.select("id", factors.ordinal(df, "t").alias("o")).collect()}
        assert got == {(1, 2), (2, 1), (3, None), (4, None), (5, 3), (6, 1)}
    assert factors.levels_of(frame, "y") is None


def test_tables_pairs_and_terms_follow_the_order(frame):
    table = factors.with_level_order(categorical_table(frame, "y", ["t"]), frame)
    rows = [(r.level, r.level_label) for r in table.where("stratum = 'Total'").orderBy("ordinal").collect()]
    assert rows == [("cold", "cold"), ("warm", "warm"), ("hot", "Very hot")]
    assert factors.level_pairs(frame, "t")[:2] == [("cold", "warm"), ("cold", "hot")]
    assert list(factors.design(frame, ["id"], {"t": None}).terms()) == ["id", "t=warm", "t=hot", "t=never"]
    assert list(factors.design(frame, factors={"t": "warm"}).terms()) == ["t=cold", "t=hot", "t=never"]


def test_wrong_levels_are_refused(frame):
    with pytest.raises(ValueError):
        factors.as_factor(frame, "t", ["a", "a"])
    with pytest.raises(ValueError):
        factors.as_factor(frame, "t", ["a"], {"b": "B"})
    with pytest.raises(ValueError):
        factors.level_pairs(frame, "y")
