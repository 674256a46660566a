"""Stratified baseline tables and cross-tabulations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.columns import labelled
from episodica.operators.hypothesis import chi_square, kruskal
from episodica.operators.ranks import VARIABLE, exact_quantiles, histogram, long_values, stacked

TOTAL = "Total"
STRATUM = "stratum"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _stratified(df: DataFrame, stratum: str) -> DataFrame:
    return df.where(F.col(stratum).isNotNull()).withColumn(STRATUM, F.col(stratum).cast("string"))


def numeric_table(
    df: DataFrame, stratum: str, variables: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Known and missing count, mean, SD, quartiles by stratum and in total.

    ``approximate`` replaces exact quartiles by sketches merged in the same
    single pass, for frames where even the histogram of a column is too large.
    """
    rows = _stratified(df, stratum)
    stats = []
    for v in variables:
        c = F.col(v).cast("double")
        parts = [F.count(c).alias("n"), F.count_if(c.isNull()).alias("missing"),
                 F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")]
        if approximate:
            parts.append(F.percentile_approx(c, list(QUARTILES.values()), 10000).alias("quartiles"))
        stats.append(F.struct(F.lit(v).alias(VARIABLE), *parts).alias(f"_{v}"))
    per_stratum = rows.rollup(STRATUM).agg(*stats)
    moments = per_stratum.select(
        F.coalesce(STRATUM, F.lit(TOTAL)).alias(STRATUM), F.inline(F.array(*[f"_{v}" for v in variables]))
    )
    if approximate:
        quartiles = [F.col("quartiles")[i].alias(n) for i, n in enumerate(QUARTILES)]
        return moments.select(VARIABLE, STRATUM, "n", "missing", "mean", "sd", *quartiles)
    hist = histogram(long_values(rows, variables, [STRATUM]), [VARIABLE, STRATUM])
    # Each row counts for its stratum and for the total.
    both = hist.withColumn(STRATUM, F.explode(F.array(STRATUM, F.lit(TOTAL))))
    quartiles = exact_quantiles(both, [VARIABLE, STRATUM], QUARTILES)
    return moments.join(quartiles, [VARIABLE, STRATUM], "left").select(
        VARIABLE, STRATUM, "n", "missing", "mean", "sd", *QUARTILES
    )


def _level_counts(df: DataFrame, stratum: str, variables: Sequence[str]) -> DataFrame:
    long = stacked(_stratified(df, stratum), variables, [STRATUM], "level", "string")
    return long.groupBy(VARIABLE, STRATUM, "level").agg(F.count(F.lit(1)).alias("n"))


def categorical_table(df: DataFrame, stratum: str, variables: Sequence[str]) -> DataFrame:
    """Count and percent of known values per level, and missing count, by stratum and in total.

    Every level of a variable has a row in every stratum, with 0 where it does not occur; a stratum without any
    known value has its levels with count 0, no percent and its missing count.
    """
    counts = _level_counts(df, stratum, variables)
    pooled = counts.groupBy(VARIABLE, "level").agg(F.sum("n").alias("n")).withColumn(STRATUM, F.lit(TOTAL))
    both = counts.unionByName(pooled)
    # One row per variable, stratum and level is left here; the grid below is as small.
    sizes = both.groupBy(VARIABLE, STRATUM).agg(
        F.sum(F.when(F.col("level").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )
    levels = counts.where(F.col("level").isNotNull()).select(VARIABLE, "level").distinct()
    cells = sizes.join(levels, VARIABLE).join(both, [VARIABLE, STRATUM, "level"], "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return cells.select(VARIABLE, "level", STRATUM, n.alias("n"), (n * 100.0 / F.nullif("known", F.lit(0))).alias("pct"), "missing")


def crosstab(
    df: DataFrame, row: str, col: str, row_levels: Sequence[str], col_levels: Sequence[str]
) -> DataFrame:
    """Counts of every listed level pair, including empty cells."""
    listed = F.col(row).isin(list(row_levels)) & F.col(col).isin(list(col_levels))
    counts = df.where(listed).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    cells = [(a, b) for a in row_levels for b in col_levels]
    schema = df.select(row, col).schema
    grid = df.sparkSession.createDataFrame(cells, schema)
    return grid.join(counts, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).alias("n"))


def numeric_tests(df: DataFrame, stratum: str, variables: Sequence[str]) -> DataFrame:
    """Kruskal-Wallis test of each numeric column across the strata."""
    return kruskal(_stratified(df, stratum), STRATUM, variables)


def categorical_tests(df: DataFrame, stratum: str, variables: Sequence[str], yates: bool = False) -> DataFrame:
    """Chi-square test of each categorical column across the strata."""
    counts = _level_counts(df, stratum, variables).where(F.col("level").isNotNull())
    return chi_square(counts, [VARIABLE], STRATUM, "level", "n", yates)


def baseline_table(
    df: DataFrame, stratum: str, numeric: Sequence[str], categorical: Sequence[str],
    labels: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Numeric and categorical halves of a baseline table, each with its test and display label."""
    num = numeric_table(df, stratum, numeric).join(
        numeric_tests(df, stratum, numeric).select(VARIABLE, "statistic", "df", "p"), VARIABLE, "left"
    )
    cat = categorical_table(df, stratum, categorical).join(
        categorical_tests(df, stratum, categorical).select(VARIABLE, "statistic", "df", "p"), VARIABLE, "left"
    )
    label = labelled(VARIABLE, labels) if labels else F.col(VARIABLE)
    return num.withColumn("label", label), cat.withColumn("label", label)
