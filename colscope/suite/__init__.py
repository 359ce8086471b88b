"""Named queries over the test tables, each with its SQL twin where SQL can say the same."""

from . import (  # noqa: F401
    anomalies, catalogs, cleaning, composites, formulas, inference, modelling, pairs, profiles, sources_and_sinks,
    sql_datasets,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
