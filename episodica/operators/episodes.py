"""Choice of episodes: qualifying keys, lookups and first episode per person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which a mapping is broadcast; a larger one is joined by a shuffle.
MAPPING_ROWS = 100_000


def bounded(mapping: DataFrame, rows: int = MAPPING_ROWS) -> DataFrame | None:
    """The mapping marked for broadcast if a count shows it to be small, else None."""
    return F.broadcast(mapping) if mapping.limit(rows + 1).count() <= rows else None


def lookup(df: DataFrame, mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join to a user-kept mapping table; a repeated mapping key repeats rows.

    Events are not shuffled on the few texts of a small mapping. A large one carries no hint: adaptive execution
    splits hot keys.
    """
    return df.join(bounded(mapping) or mapping, list(on))


def qualifying_keys(
    events: DataFrame, codes: DataFrame, scores: DataFrame, key: str, code: str, score: str, at_least: int
) -> DataFrame:
    """Keys with a listed event code and a sufficient score: one row per key and score."""
    few = bounded(codes.select(code))
    # against a large list each key and code is compared once, so a hot code is combined before its shuffle
    found = events.join(few, code, "left_semi") if few else events.select(key, code).distinct().join(codes.select(code), code, "left_semi")
    enough = scores.where(F.col(score) >= at_least).select(key, score)
    return enough.join(found.select(key), key, "left_semi").distinct()


def number_episodes(df: DataFrame, person: str, order: Sequence[str], out: str = "seqnum") -> DataFrame:
    """Numbers the episodes of a person in the given order.

    Filtering the result to 1 lets Spark keep one row per person and task
    before the shuffle, so a person with very many episodes stays cheap.
    """
    w = Window.partitionBy(person).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn(out, F.row_number().over(w))


def first_episode(df: DataFrame, person: str, order: Sequence[str]) -> DataFrame:
    return number_episodes(df, person, order, "_seq").where(F.col("_seq") == 1).drop("_seq")
