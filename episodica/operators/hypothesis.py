"""Rank, contingency and pairwise tests computed from distributed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.normal import normal_quantile_sql
from episodica.functions.pvalues import chi2_p, t_p
from episodica.operators.ranks import (
    VARIABLE,
    histogram,
    long_values,
    ordered,
    repeat_rows,
    running_totals,
    with_group_totals,
)


def kruskal(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H of each variable across the groups."""
    long = long_values(df.where(F.col(group).isNotNull()), variables, [group])
    # one row per value with the counts of its groups, so that equal values share their ranks
    cells = F.collect_list(F.struct(group, "n"))
    cut = ordered(histogram(long, [VARIABLE, group]), [VARIABLE], ["value"], {"tied": F.sum("n"), "cells": cells})
    ranked = running_totals(cut, [VARIABLE], {"rank": "tied"})
    midrank = F.col("rank_upto") - (F.col("tied") - 1) / 2.0
    ranked = ranked.select(VARIABLE, "tied", midrank.alias("midrank"), F.inline("cells"))
    n, tied_n = F.col("n").cast("double"), F.col("tied").cast("double")
    sums = ranked.groupBy(VARIABLE, group).agg(
        F.sum(n * F.col("midrank")).alias("rank_sum"),
        F.sum(n).alias("size"),
        F.sum(n * (tied_n * tied_n - 1)).alias("ties"),
    )
    total = F.col("total")
    h = F.lit(12.0) / (total * (total + 1)) * F.col("weighted") - 3 * (total + 1)
    return (
        sums.groupBy(VARIABLE)
        .agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("weighted"),
             F.sum("size").alias("total"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("k"))
        .select(
            VARIABLE,
            F.try_divide(h, 1 - F.try_divide(F.col("ties"), total * total * total - total)).alias("statistic"),
            (F.col("k") - 1).cast("int").alias("df"),
        )
        .withColumn("p", chi2_p(F.col("statistic"), F.col("df")))
    )


def chi_square(
    counts: DataFrame, by: Sequence[str], row: str, col: str, n: str, yates: bool = False
) -> DataFrame:
    """Chi-square test of independence of each table of counts.

    Works from non-empty cells: an empty cell adds its expected count, and those
    sum to what the non-empty cells leave of the total. ``yates`` applies the
    continuity correction to 2x2 tables.
    """
    # The input holds one row per table cell, so these windows are small.
    margins = counts.withColumns({
        "_r": F.sum(n).over(Window.partitionBy(*by, row)).cast("double"),
        "_c": F.sum(n).over(Window.partitionBy(*by, col)).cast("double"),
        "_t": F.sum(n).over(Window.partitionBy(*by)).cast("double"),
    })
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    gap = F.col(n) - expected
    tables = margins.where(F.col("_t") > 0).groupBy(*by).agg(
        F.sum(F.when(expected > 0, gap * gap / expected)).alias("_seen"),
        F.sum(expected).alias("_covered"),
        F.max("_t").alias("total"),
        F.max(F.abs(gap)).alias("_gap"),
        F.countDistinct(F.when(F.col(n) > 0, F.col(row))).alias("_rows"),
        F.countDistinct(F.when(F.col(n) > 0, F.col(col))).alias("_cols"),
        F.max("_r").alias("_r1"),
        F.max("_c").alias("_c1"),
    )
    plain = F.col("_seen") + (F.col("total") - F.col("_covered"))
    r1, c1, t = F.col("_r1"), F.col("_c1"), F.col("total")
    # In a 2x2 table every cell lies equally far from its expected count.
    inverse_sum = t * (1 / r1 + 1 / F.nullif(t - r1, F.lit(0.0))) * (1 / c1 + 1 / F.nullif(t - c1, F.lit(0.0)))
    moved = F.greatest(F.col("_gap") - 0.5, F.lit(0.0))
    square = (F.col("_rows") == 2) & (F.col("_cols") == 2)
    stat = F.when(square, moved * moved * inverse_sum).otherwise(plain) if yates else plain
    return tables.select(
        *by,
        stat.alias("statistic"),
        ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("int").alias("df"),
        t.cast("bigint").alias("total"),
    ).withColumn("p", chi2_p(F.col("statistic"), F.col("df")))


def independence(df: DataFrame, row: str, col: str, yates: bool = True) -> DataFrame:
    """Chi-square test of two columns of a frame."""
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    counts = known.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return chi_square(counts.withColumn("test", F.lit(f"{row} x {col}")), ["test"], row, col, "n", yates)


def adjust_p(df: DataFrame, by: Sequence[str], p: str, method: str, out: str = "p_adjusted") -> DataFrame:
    """Holm or Benjamini-Hochberg adjustment within one family of result rows."""
    family = Window.partitionBy(*by)
    m, rank = F.count(p).over(family), F.row_number().over(family.orderBy(F.asc_nulls_last(p)))
    ranked = df.withColumns({"_m": m, "_rank": rank})
    if method == "holm":
        raw = (F.col("_m") - F.col("_rank") + 1) * F.col(p)
        edge = family.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
        adjusted = F.max("_raw").over(edge)
    elif method == "bh":
        raw = F.col("_m") / F.col("_rank") * F.col(p)
        edge = family.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
        adjusted = F.min("_raw").over(edge)
    else:
        raise ValueError(f"unknown method {method}")
    return (
        ranked.withColumn("_raw", raw)
        .withColumn(out, F.when(F.col(p).isNotNull(), F.least(adjusted, F.lit(1.0))))
        .drop("_m", "_rank", "_raw")
    )


def level_pairs(levels: DataFrame, group: str, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pairs (a < b) of the summary rows of factor levels: one small array per family."""
    packed = levels.groupBy(*by).agg(F.collect_list(F.struct(group, *columns)).alias("_levels"))
    first = packed.select(*by, "_levels", F.explode("_levels").alias("a"))
    later = F.filter("_levels", lambda x: x[group] > F.col("a")[group])
    return first.select(*by, "a", F.explode(later).alias("b"))


def pairwise_t(df: DataFrame, value: str, group: str, method: str = "holm") -> DataFrame:
    """t tests of all level pairs with the SD pooled over all levels."""
    v = F.col(value).cast("double")
    levels = (
        df.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
             F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))
        .withColumn("test", F.lit(value))
    )
    family = Window.partitionBy("test")
    freedom = F.sum(F.col("n") - 1).over(family)
    spread = F.sum((F.col("n") - 1) * F.col("var")).over(family)
    levels = levels.withColumns({"dof": freedom, "pooled": spread / F.nullif(freedom, F.lit(0))})
    pairs = level_pairs(levels, group, ["n", "mean", "dof", "pooled"], ["test"])
    se = F.sqrt(F.col("a.pooled")) * F.sqrt(1 / F.col("a.n") + 1 / F.col("b.n"))
    out = pairs.select(
        "test", F.col(f"a.{group}").alias("level_a"), F.col(f"b.{group}").alias("level_b"),
        F.try_divide(F.col("b.mean") - F.col("a.mean"), se).alias("statistic"), F.col("a.dof").alias("df"),
    ).withColumn("p", t_p(F.col("statistic"), F.col("df")))
    return adjust_p(out, ["test"], "p", method)


def pairwise_chi_square(
    df: DataFrame, group: str, outcome: str, yates: bool = True, method: str = "bh"
) -> DataFrame:
    """Chi-square tests of the outcome between all pairs of group levels."""
    known = df.where(F.col(group).isNotNull() & F.col(outcome).isNotNull())
    counts = known.groupBy(group, outcome).agg(F.count(F.lit(1)).alias("n")).withColumn("test", F.lit(outcome))
    # The counts of one level are one map of the few outcome values.
    levels = counts.groupBy("test", group).agg(
        F.collect_list(F.struct(F.col(outcome).cast("string").alias("outcome"), "n")).alias("cells")
    )
    pairs = level_pairs(levels, group, ["cells"], ["test"])
    sides = pairs.select(
        "test", F.col(f"a.{group}").alias("level_a"), F.col(f"b.{group}").alias("level_b"),
        F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("a.cells").alias("cells")),
            F.struct(F.lit("b").alias("side"), F.col("b.cells").alias("cells")),
        )).alias("half"),
    ).select("test", "level_a", "level_b", "half.side", F.inline("half.cells"))
    tests = chi_square(sides, ["test", "level_a", "level_b"], "side", "outcome", "n", yates)
    return adjust_p(tests, ["test"], "p", method)


def qq_points(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Sample against theoretical normal quantiles, one row per observation."""
    cut = ordered(histogram(long_values(df, variables), [VARIABLE]), [VARIABLE], ["value"])
    ranked = with_group_totals(running_totals(cut, [VARIABLE], {"n": "n"}), [VARIABLE], {"n": "n"})
    points = repeat_rows(ranked, "n", "_copy", [VARIABLE, "value"])
    position = F.col("n_upto") - F.col("n") + F.col("_copy") + 1
    offset = F.when(F.col("n_all") > 10, 0.5).otherwise(0.375)
    share: Column = (position - offset) / (F.col("n_all") + 1 - 2 * offset)
    return points.select(
        VARIABLE, position.alias("rank"), share.alias("share"), F.col("value").alias("sample")
    ).withColumn("theoretical", F.expr(normal_quantile_sql("share")))
