"""Registered queries over the driver tables, by subject."""

from vitalgrid.plans import (
    contract,
    decode,
    derived,
    gates,
    indicators,
    models,
    mortality,
    presentation,
    sources,
    structure,
    timeseries,
)  # noqa: F401
from vitalgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
