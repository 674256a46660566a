"""Queries for the cleaning operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.functions import columns as fn
from episodica.session import ensure_checkpoint_dir
from episodica.sources.tables import emit, read_csv, write_dataset

# Text-coded ages with the top code, unreadable text and gaps.
AGE_SQL = """
    CASE WHEN o_orderkey % 11 = 0 THEN '> 89' WHEN o_orderkey % 13 = 0 THEN 'abc' WHEN o_orderkey % 17 = 0 THEN NULL
         ELSE CAST(15 + o_orderkey % 70 AS VARCHAR) END
"""


def _age() -> Column:
    k = F.col("o_orderkey")
    return (
        F.when(k % 11 == 0, "> 89").when(k % 13 == 0, "abc").when(k % 17 == 0, F.lit(None))
        .otherwise((15 + k % 70).cast("string"))
    )


@register("recode", """
    SELECT o_orderkey AS stay, CASE sex WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS sex_label
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS sex FROM orders)
    WHERE sex IS NOT NULL
""")
def recode(s: Sample) -> DataFrame:
    status = F.col("o_orderstatus")
    sex = F.when(status == "F", 0).when(status == "O", 1).cast("string")
    return (
        s.table("orders").select(F.col("o_orderkey").alias("stay"), sex.alias("sex"))
        .withColumn("sex_label", fn.recode("sex", {"0": "Female", "1": "Male"}))
        .na.drop(subset=["sex_label"]).drop("sex")
    )


@register("age_numeric", f"""
    SELECT stay, age_years FROM (
      SELECT o_orderkey AS stay, TRY_CAST(CASE WHEN age = '> 89' THEN '91.5' ELSE age END AS DOUBLE) AS age_years
      FROM (SELECT o_orderkey, {AGE_SQL} AS age FROM orders)) WHERE age_years IS NOT NULL
""")
def age_numeric(s: Sample) -> DataFrame:
    ages = s.table("orders").select(F.col("o_orderkey").alias("stay"), _age().alias("age"))
    years = fn.numeric_text("age", {"> 89": "91.5"})
    return ages.select("stay", years.alias("age_years")).na.drop(subset=["age_years"])


FLAGS_SQL = """
    SELECT o_orderkey AS stay,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS a,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS b
    FROM orders
"""


def _two_flags(s: Sample) -> DataFrame:
    k = F.col("o_orderkey")
    return s.table("orders").select(
        k.alias("stay"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, 1).otherwise(0).alias("a"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 4 == 0, 1).otherwise(0).alias("b"),
    )


@register("or_flag", f"""
    SELECT stay, CASE WHEN a = 1 OR b = 1 THEN 1 WHEN NOT (a = 1 OR b = 1) THEN 0 END AS either FROM ({FLAGS_SQL})
""")
def or_flag(s: Sample) -> DataFrame:
    return _two_flags(s).select("stay", fn.either_flag("a", "b").alias("either"))


@register("outcome_override", f"""
    SELECT stay, CASE WHEN a = 1 THEN 1 ELSE b END AS hospital_death FROM ({FLAGS_SQL})
""")
def outcome_override(s: Sample) -> DataFrame:
    return _two_flags(s).select("stay", fn.override_where("b", F.col("a") == 1, 1).alias("hospital_death"))


@register("merge_levels", """
    SELECT c_custkey AS person, CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'HOME' ELSE c_mktsegment END
             AS segment, CASE WHEN c_mktsegment IN ('FURNITURE') THEN 1 ELSE 0 END AS listed
    FROM customer
""")
def merge_levels(s: Sample) -> DataFrame:
    return s.table("customer").select(
        F.col("c_custkey").alias("person"),
        fn.merge_levels("c_mktsegment", ["FURNITURE", "HOUSEHOLD"], "HOME").alias("segment"),
        fn.member("c_mktsegment", ["FURNITURE"]).cast("int").alias("listed"),
    )


@register("left_closed_bins", """
    SELECT p_partkey AS item,
           CASE WHEN t < 10 THEN '< 10' WHEN t < 20.5 THEN '10 ~ 20.4' WHEN t < 37 THEN '20.5 ~ 36.9' ELSE '>= 37' END AS bin,
           CASE WHEN t < 10 THEN 1 WHEN t < 20.5 THEN 2 WHEN t < 37 THEN 3 ELSE 4 END AS ordinal
    FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS t FROM part)
""")
def left_closed_bins(s: Sample) -> DataFrame:
    breaks = [10, 20.5, 37]
    size = F.col("p_size").cast("double")
    return s.table("part").select(
        F.col("p_partkey").alias("item"),
        fn.left_closed_bin(size, breaks, ["< 10", "10 ~ 20.4", "20.5 ~ 36.9", ">= 37"]).alias("bin"),
        fn.bin_ordinal(size, breaks).alias("ordinal"),
    )


@register("derived_index", """
    SELECT item, weight, height, round(CASE WHEN bmi BETWEEN 15 AND 100 THEN bmi END, 6) AS bmi
    FROM (SELECT *, weight / ((height / 100) * (height / 100)) AS bmi
          FROM (SELECT p_partkey AS item, CASE WHEN h BETWEEN 50 AND 300 THEN h END AS height,
                       CASE WHEN w BETWEEN 20 AND 600 THEN w END AS weight
                FROM (SELECT p_partkey, CAST(p_size * 7 AS DOUBLE) AS h, p_retailprice / 10 AS w FROM part)))
""")
def derived_index(s: Sample) -> DataFrame:
    raw = s.table("part").select(
        F.col("p_partkey").alias("item"),
        fn.keep_range((F.col("p_size") * 7).cast("double"), 50, 300).alias("height"),
        fn.keep_range(F.col("p_retailprice") / 10, 20, 600).alias("weight"),
    )
    bmi = fn.keep_range(fn.mass_index("weight", "height"), 15, 100)
    return raw.withColumn("bmi", F.round(bmi, 6))


@register("adult_first_visit", f"""
    SELECT stay, age_years FROM (
      SELECT o_orderkey AS stay, o_orderkey % 3 AS visit, TRY_CAST({AGE_SQL} AS DOUBLE) AS age_years FROM orders)
    WHERE age_years >= 18 AND visit = 1
""")
def adult_first_visit(s: Sample) -> DataFrame:
    from episodica.operators.clean import adult_first_visits

    rows = s.table("orders").select(
        F.col("o_orderkey").alias("stay"), (F.col("o_orderkey") % 3).alias("visit"),
        fn.numeric_text(_age()).alias("age_years"),
    )
    return adult_first_visits(rows, "age_years", "visit").drop("visit")


@register("stack_cohorts", """
    SELECT o_orderkey AS stay, 1 AS sepsis, o_orderpriority AS race,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes-Region'
                WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'Non-Region' END AS race1
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT o_orderkey, 0, o_orderpriority,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes-Region'
                WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'Non-Region' END
    FROM orders WHERE o_orderstatus = 'O'
""")
def stack_cohorts(s: Sample) -> DataFrame:
    rows = s.table("orders").select(
        F.col("o_orderkey").alias("stay"), F.col("o_orderpriority").alias("race"), "o_orderstatus"
    )
    first = rows.where("o_orderstatus = 'F'").select("stay", F.lit(1).alias("sepsis"), "race")
    second = rows.where("o_orderstatus = 'O'").select("race", F.lit(0).alias("sepsis"), "stay")
    near, far = fn.member("race", ["1-URGENT", "2-HIGH"]), fn.member("race", ["3-MEDIUM", "5-LOW"])
    return first.unionByName(second).withColumn(
        "race1", F.when(near, "Yes-Region").when(far, "Non-Region")
    )


@register("level_order", """
    SELECT o_orderkey AS stay,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
                WHEN '5-LOW' THEN 4 END AS ordinal
    FROM orders
""")
def level_order(s: Sample) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    return s.table("orders").select(
        F.col("o_orderkey").alias("stay"), fn.level_ordinal("o_orderpriority", levels).alias("ordinal")
    )


@register("label_map", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicks, n' WHEN 'view' THEN 'Views, n' ELSE event_type END AS label
    FROM events
""")
def label_map(s: Sample) -> DataFrame:
    labels = {"click": "Clicks, n", "view": "Views, n"}
    return s.table("events").select("event_id", fn.labelled("event_type", labels).alias("label"))


def _stage_path(s: Sample, name: str) -> str:
    """A new place in the shared folder for a stage result."""
    return f"{ensure_checkpoint_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


STAGE_SQL = """
    SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE o_orderstatus END AS note,
           CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS price
    FROM orders
"""


def _stage(s: Sample) -> DataFrame:
    """The whole table with all its columns, a text with blanks and unknowns, and a number with unknowns."""
    n = F.col("o_orderkey")
    note = F.when(n % 5 == 0, "").when(n % 5 != 1, F.col("o_orderstatus"))
    return s.table("orders").select("*", note.alias("note"), F.when(n % 7 > 0, F.col("o_totalprice")).alias("price"))


@register("csv_import", STAGE_SQL)
def csv_import(s: Sample) -> DataFrame:
    rows, path = _stage(s), _stage_path(s, "csv")
    emit(rows, path, "csv")
    return read_csv(s.spark, path, rows.schema)


@register("csv_inferred", STAGE_SQL)
def csv_inferred(s: Sample) -> DataFrame:
    rows, path = _stage(s), _stage_path(s, "csv-inferred")
    emit(rows, path, "csv")
    found = read_csv(s.spark, path)
    # the narrowest types that hold all values, read as the stage has them
    return found.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])


@register("dataset_checkpoint", STAGE_SQL)
def dataset_checkpoint(s: Sample) -> DataFrame:
    return write_dataset(_stage(s), _stage_path(s, "stage"))
