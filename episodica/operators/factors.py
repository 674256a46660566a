"""Factors: text columns whose levels have an order and display labels.

The level dictionary is kept in the column's metadata. It passes through selects,
filters and joins, and stage files keep it in their schema, so tables, pairs and model terms come in
the same order wherever the frame comes from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.columns import level_ordinal
from episodica.operators.models import Design

LEVELS, LABELS = "levels", "level_labels"


def as_factor(df: DataFrame, column: str, levels: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Give a text column its ordered levels; other values become NULL. Levels without a label are their own."""
    levels = list(levels)
    if len(set(levels)) != len(levels):
        raise ValueError(f"levels of {column} repeat")
    if set(labels or {}) - set(levels):
        raise ValueError(f"labels of {column} name other levels")
    kept = df.withColumn(column, F.when(F.col(column).isin(levels), F.col(column)))
    return kept.withMetadata(column, {**df.schema[column].metadata, LEVELS: levels, LABELS: [(labels or {}).get(x, x) for x in levels]})


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The ordered levels of a factor; None for other columns."""
    return df.schema[column].metadata.get(LEVELS)


def labels_of(df: DataFrame, column: str) -> dict[str, str]:
    meta = df.schema[column].metadata
    return dict(zip(meta.get(LEVELS, []), meta.get(LABELS, [])))


def ordinal(df: DataFrame, column: str) -> Column:
    """1-based position of a factor's value, NULL for a missing one."""
    return level_ordinal(column, _required(df, column))


def level_pairs(df: DataFrame, column: str) -> list[tuple[str, str]]:
    """All pairs of levels in their order."""
    return list(combinations(_required(df, column), 2))


def design(df: DataFrame, numeric: Sequence[str] = (), factors: Mapping[str, str | None] | None = None) -> Design:
    """Model terms with the factors' own levels; without a stated reference the first level is it."""
    coded = {}
    for name, reference in (factors or {}).items():
        levels = _required(df, name)
        coded[name] = (tuple(levels), reference if reference is not None else levels[0])
    return Design(numeric=tuple(numeric), factors=coded)


def with_level_order(table: DataFrame, df: DataFrame, variable: str = "variable", level: str = "level") -> DataFrame:
    """Add ``ordinal`` and ``level_label`` to rows of (variable, level), from the factors of ``df``.

    Columns of ``df`` that are no factors have no ordinal and their levels as labels.
    """
    pos, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name in df.columns:
        if levels_of(df, name):
            here = F.col(variable) == name
            pos = F.when(here, level_ordinal(level, levels_of(df, name))).otherwise(pos)
            pairs = [F.lit(x) for kv in labels_of(df, name).items() for x in kv]
            label = F.when(here, F.try_element_at(F.create_map(*pairs), F.col(level))).otherwise(label)
    return table.withColumns({"ordinal": pos, "level_label": F.coalesce(label, F.col(level))})


def _required(df: DataFrame, column: str) -> list[str]:
    levels = levels_of(df, column)
    if not levels:
        raise ValueError(f"{column} has no levels; give it some with as_factor")
    return levels
