"""Summaries of charted events inside an offset window from admission."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.columns import guarded_ratio
from episodica.operators.ranks import PART, ordered, running_totals

AGGREGATES = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}

Bounds = tuple[int, int]


def in_window(df: DataFrame, offset: str, bounds: Bounds) -> DataFrame:
    """Events with an offset inside the inclusive bounds."""
    return df.where(F.col(offset).between(*bounds))


def summarise_window(
    df: DataFrame, key: str, offset: str, bounds: Bounds | None, outputs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """``outputs`` maps a result name to (aggregate, value column)."""
    rows = df if bounds is None else in_window(df, offset, bounds)
    return rows.groupBy(key).agg(
        *[AGGREGATES[how](F.col(value)).alias(name) for name, (how, value) in outputs.items()]
    )


def pivot_extremes(
    df: DataFrame, keys: Sequence[str], name: str, value: str, outputs: Mapping[str, tuple[str, str]],
    limits: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Long to wide in one aggregation: result name -> (aggregate, measurement name).

    Values outside the inclusive limits of their measurement are left out.
    """
    aggs = []
    for out, (how, measurement) in outputs.items():
        wanted = F.col(name) == measurement
        if limits and measurement in limits:
            wanted = wanted & F.col(value).between(*limits[measurement])
        aggs.append(AGGREGATES[how](F.when(wanted, F.col(value))).alias(out))
    return df.groupBy(*keys).agg(*aggs)


def measurement_extremes(
    base: DataFrame, events: DataFrame, key: str, name: str, value: str, offset: str,
    bounds: Bounds, limits: Mapping[str, tuple[float, float]], outputs: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Window filter, plausibility limits, pivot; keys without events get NULLs."""
    wanted = sorted({m for _, m in outputs.values()})
    rows = in_window(events, offset, bounds).where(F.col(name).isin(wanted))
    wide = pivot_extremes(rows, [key], name, value, outputs, limits)
    return base.select(key).distinct().join(wide, key, "left")


def ratio_of_extremes(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """Adds num / den where both are positive, else NULL."""
    ok = (F.col(num) > 0) & (F.col(den) > 0)
    return df.withColumn(out, F.when(ok, guarded_ratio(num, den)))


def extreme_ratio(
    df: DataFrame, key: str, num: str, den: str, out: str, how: str = "min", zero_den: float | None = None
) -> DataFrame:
    """Least or greatest row-wise ratio per key, over rows where both parts are known."""
    known = df.where(F.col(num).isNotNull() & F.col(den).isNotNull())
    return known.groupBy(key).agg(AGGREGATES[how](guarded_ratio(num, den, zero_den)).alias(out))


def merge_series(parts: Sequence[tuple[DataFrame, str]], keys: Sequence[str], out: str) -> DataFrame:
    """Stack the known values of several signals into one series."""
    merged = None
    for df, signal in parts:
        rows = df.where(F.col(signal).isNotNull()).select(*keys, F.col(signal).alias(out))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


def attach_series_summary(
    left: DataFrame, series: DataFrame, key: str, outputs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Left-join per-key summaries of a series.

    Joining two series row by row inside a key repeats every row equally often,
    which changes no maximum, minimum or mean; aggregating each side first gives
    the same result from n + m rows instead of n * m.
    """
    summary = summarise_window(series, key, "", None, outputs)
    return left.join(summary, key, "left")


def tagged_extremes(
    df: DataFrame, key: str, value: str, tag: str,
    subsets: Mapping[str, Column | None],
) -> DataFrame:
    """Greatest and least value with its tag, per key, over several tag subsets.

    ``subsets`` maps a suffix to a condition on the tag (None: all rows). The
    first aggregation over (key, tag) uses plain numeric maxima, combines
    map-side and leaves a few rows per key whatever the number of events; the
    second picks value and tag together. Equal values: the later tag in text
    order wins for the maximum and the earlier one for the minimum.
    """
    per_tag = df.groupBy(key, tag).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    aggs = []
    for suffix, condition in subsets.items():
        hi, lo = F.struct("_hi", tag), F.struct("_lo", tag)
        if condition is not None:
            hi, lo = F.when(condition, hi), F.when(condition, lo)
        aggs += [F.max(hi).alias(f"_max_{suffix}"), F.min(lo).alias(f"_min_{suffix}")]
    picked = per_tag.groupBy(key).agg(*aggs)
    out = [F.col(key)]
    for suffix in subsets:
        out += [
            F.col(f"_max_{suffix}._hi").alias(f"max_{suffix}"),
            F.col(f"_max_{suffix}.{tag}").alias(f"max_{suffix}_{tag}"),
            F.col(f"_min_{suffix}._lo").alias(f"min_{suffix}"),
            F.col(f"_min_{suffix}.{tag}").alias(f"min_{suffix}_{tag}"),
        ]
    return picked.select(*out)


def tag_choices(mapping: DataFrame, name: str, tag: str, subsets: Mapping[str, Column | None]) -> DataFrame:
    """One row per ``name`` of a mapping: for each subset of tags its first and last tag, and whether it has any.

    A name mapped to several tags would repeat rows in a join; here it keeps one. An unknown tag comes before all others.
    """
    aggs = []
    for suffix, condition in subsets.items():
        inside = F.lit(True) if condition is None else condition
        unknown = F.count_if(inside & F.col(tag).isNull()) > 0
        aggs += [
            (F.count_if(inside) > 0).alias(f"_in_{suffix}"), F.max(F.when(inside, F.col(tag))).alias(f"_last_{suffix}"),
            F.when(~unknown, F.min(F.when(inside, F.col(tag)))).alias(f"_first_{suffix}"),
        ]
    return mapping.where(F.col(name).isNotNull()).groupBy(name).agg(*aggs)


def merged_extremes(value: str, tag: str, subsets: Sequence[str]) -> list[Column]:
    """Aggregates of the second level: from states with ``<value>_hi``, ``<value>_lo`` and ``tag_choices`` to the columns of ``tagged_extremes``."""
    out = []
    for s in subsets:
        for how, side, choice in ((F.max, "hi", "last"), (F.min, "lo", "first")):
            known = F.coalesce(F.col(f"_in_{s}"), F.lit(False)) & F.col(f"{value}_{side}").isNotNull()
            best = how(F.when(known, F.struct(F.col(f"{value}_{side}").alias("v"), F.col(f"_{choice}_{s}").alias("t"))))
            name = f"{'max' if side == 'hi' else 'min'}_{s}"
            out += [best["v"].alias(name), best["t"].alias(f"{name}_{tag}")]
    return out


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "row_number") -> DataFrame:
    """Every row's number within its key, in the given order, without a filter.

    Rows are numbered inside range partitions of (key, order) and shifted by what earlier partitions hold of the key, so a
    key with very many rows spreads over all tasks; a window would sort it in one. Rows that ``order`` does not
    tell apart are numbered as they come; a NULL key is a key. Only a filter on the first ranks is better left to a window.
    """
    # unknown keys get a flag of their own, as groups must be known
    known = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    unknown = {f"_u{i}": F.col(k).isNull().cast("int") for i, k in enumerate(keys)}
    within = [*known, *unknown]
    cut = ordered(df.withColumns(known | unknown), within, order)
    return running_totals(cut, within, {out: F.lit(1).cast("bigint")}).drop(PART, *within).withColumnRenamed(f"{out}_upto", out)
