import pytest
from pyspark.sql import functions as F

from episodica.operators import factors
from episodica.sources.stages import StageStore


@pytest.fixture()
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path / "stages"), buckets=4)


def numbers(spark, n=50):
    return spark.range(n).select((F.col("id") % 7).alias("stay"), F.col("id").alias("x"), F.lit("t").alias("odd name"))


def test_built_once_for_the_same_inputs(spark, store):
    calls = []

    def build():
        calls.append(1)
        return numbers(spark)

    for key in (None, "stay"):
        calls.clear()
        for inputs, want in (("v1", 1), ("v1", 1), ("v2", 2)):
            out = store.keep("rows", inputs, build, key)
            assert len(calls) == want and out.columns == ["stay", "x", "odd name"]
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, numbers(spark).collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_star_of_stages_shuffles_nothing(spark, store):
    base = store.keep("base", "v1", lambda: numbers(spark).select("stay").distinct(), "stay")
    parts = [store.keep(f"part{k}", "v1", lambda k=k: numbers(spark).groupBy("stay").agg(F.max(F.col("x") + k).alias(f"x{k}")), "stay") for k in range(3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = base
        for p in parts:
            star = star.join(p, "stay", "left")
        assert exchanges(star) == 0 and exchanges(star.groupBy("stay").agg(F.max("x0"))) == 0
        assert {(r.stay, r.x1 - r.x0, r.x2 - r.x0) for r in star.collect()} == {(k, 1, 2) for k in range(7)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_later_session_finds_buckets_and_levels(spark, store):
    frame = lambda: factors.as_factor(numbers(spark).withColumn("g", F.lit("b")), "g", ["c", "b"])
    store.keep("levels", "v1", frame, "stay")
    for t in spark.catalog.listTables():
        if t.name.startswith("stage_data"):
            spark.sql(f"DROP TABLE {t.name}")
    again = store.keep("levels", "v1", lambda: pytest.fail("built twice"), "stay")
    assert again.count() == 50 and factors.levels_of(again, "g") == ["c", "b"]
    assert exchanges(again.groupBy("stay").count()) == 0


def test_half_written_stages_are_never_read(spark, store, tmp_path):
    def fails():
        return numbers(spark).withColumn("x", F.when(F.col("x") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))

    for key in (None, "stay"):
        with pytest.raises(Exception, match="lost"):
            store.keep("rows", "v1", fails, key)
        numbers(spark, 3).write.parquet(str(tmp_path / f"stages/rows/data-{key}"))  # no marker names it
        (tmp_path / store._marker_path("rows", "unused")).mkdir(parents=True, exist_ok=True)
        assert store.keep("rows", "v1", lambda: numbers(spark), key).count() == 50


def test_old_stages_go(spark, store, tmp_path):
    for inputs in ("v1", "v2", "v3"):
        store.keep("rows", inputs, lambda: numbers(spark), "stay")
    store.keep("other", "v1", lambda: numbers(spark))
    assert store.drop_others("rows", "v3", "stay") == 4
    assert len(list((tmp_path / "stages/rows").iterdir())) == 2
    assert store.keep("rows", "v3", lambda: pytest.fail("built twice"), "stay").count() == 50
    assert store.keep("rows", "v1", lambda: numbers(spark, 5), "stay").count() == 5
    assert store.keep("other", "v1", lambda: pytest.fail("built twice")).count() == 50 and store.drop_others("nothing", "v1") == 0


def test_null_keys_empty_stages_and_names(spark, store):
    some = spark.createDataFrame([(None, 1), (2, 2), (None, 3)], "stay int, x int")
    assert store.keep("nulls", "v1", lambda: some, "stay").count() == 3
    assert store.keep("empty", "v1", lambda: some.limit(0), "stay").count() == 0
    with pytest.raises(ValueError):
        store.keep("../up", "v1", lambda: some)
