"""Registry of the queries over the sample tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from episodica.sources.tables import load_sample

Build = Callable[["Sample"], DataFrame]


@dataclass(frozen=True)
class Sample:
    """The sample tables of one scale."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return load_sample(self.spark, self.sf_dir, name)


BUILDERS: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it has no SQL twin."""

    def keep(build: Build) -> Build:
        if name in BUILDERS:
            raise ValueError(f"query {name} registered twice")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = BUILDERS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Sample(spark, sf_dir))

    run.__name__ = name
    return run
