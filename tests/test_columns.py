from episodica.functions import columns as fn
from episodica.sources.tables import assert_unique, emit, nan_to_null, read_csv, write_dataset

import pytest


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_three_valued_or(spark):
    got = values(spark, [(None, 1), (None, 0), (0, 0), (1, None)], "a int, b int", fn.either_flag("a", "b"))
    assert got == [1, None, 0, 1]


def test_bins_are_left_closed(spark):
    rows = [(x,) for x in (35.9, 36.0, 37.2, 38.3, 39.0, None)]
    assert values(spark, rows, "t double", fn.bin_ordinal("t", (36, 37.2, 38.3, 39))) == [1, 2, 3, 4, 5, None]


def test_plausible_ranges(spark):
    rows = [(x,) for x in (49.0, 50.0, 300.0, 301.0, None)]
    assert values(spark, rows, "h double", fn.keep_range("h", 50, 300)) == [None, 50.0, 300.0, None, None]
    assert values(spark, [(-1.0,), (0.0,)], "s double", fn.keep_range("s", low=0)) == [None, 0.0]


def test_codes_and_hours(spark):
    rows = [("Female",), ("MALE",), ("x",), (None,)]
    assert values(spark, rows, "g string", fn.sex_code("g")) == [0, 1, None, None]
    assert values(spark, [(150,), (-150,), (149,)], "m bigint", fn.whole_hours("m")) == [3.0, -3.0, 2.0]


def test_ratio_guards(spark):
    rows = [(84.0, 0.0), (84.0, 21.0)]
    assert values(spark, rows, "a double, b double", fn.guarded_ratio("a", "b", 21)) == [4.0, 4.0]
    assert values(spark, rows, "a double, b double", fn.guarded_ratio("a", "b")) == [None, 4.0]


def test_override_keeps_value_where_condition_is_unknown(spark):
    df = spark.createDataFrame([(1, 0), (None, 0), (0, None)], "icu int, hosp int")
    got = [r[0] for r in df.select(fn.override_where("hosp", df.icu == 1, 1)).collect()]
    assert got == [1, 0, None]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, float("nan"))], "id bigint, s string, x double")
    kept = write_dataset(df, f"{tmp_path}/d")
    assert nan_to_null(kept).where("x IS NULL").count() == 1
    emit(nan_to_null(df), f"{tmp_path}/c", "csv")
    back = read_csv(spark, f"{tmp_path}/c", df.schema)
    assert sorted(back.collect()) == sorted(nan_to_null(df).collect())
    assert assert_unique(df, ["id"]) is df
    with pytest.raises(ValueError):
        assert_unique(df.union(df), ["id"])
