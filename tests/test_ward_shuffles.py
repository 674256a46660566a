"""Cohort records over tables dealt by the stay."""

import re

from pyspark.sql import functions as F

from episodica.catalog import ward
from episodica.catalog.registry import Sample
from episodica.plans import cohort as plan


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^,#]+)", text)


def test_order_lines_move_once(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = exchanges(plan.assemble(ward.ward_tables(Sample(spark, sf_dir), by_stay=True), first_only=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # selected stays go to their person and back; nothing else moves by the stay
    assert keys.count("patientunitstayid") == 1 and keys.count("uniquepid") == 1, keys


def test_dealt_tables_give_the_same_records(spark, tmp_path, sf_dir):
    # repeated rows, unknown keys and unknown persons
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        some = rows.where(F.col(key) % 5 == 0)
        rows.union(some).union(some.withColumn(key, F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    s = Sample(spark, str(tmp_path))
    dealt, plain = (ward.rounded_records(plan.assemble(ward.ward_tables(s, by_stay=x))) for x in (True, False))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
