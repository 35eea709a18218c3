"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from tarn.plans import agents, evaluation, knowledge, relational, retrieval, sources, statistics  # noqa: F401  they register
from tarn.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
