"""All queries of the panel engine; importing the modules registers them."""

from fieldspan.plans import cleaning, fitted, frontier, geodata, headline, indices, relational, stages, weather, windows  # noqa: F401
from fieldspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
