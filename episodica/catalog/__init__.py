"""Queries over the sample tables."""

from episodica.catalog import (  # noqa: F401
    clean_queries,
    feature_queries,
    index_queries,
    model_queries,
    stats_queries,
    study_queries,
    study_tables,
    ward,
)
from episodica.catalog.registry import BUILDERS, ORACLES


def all_builders() -> dict:
    return BUILDERS


def all_oracles() -> dict:
    return ORACLES
