"""All queries of the engine: importing this registers every module's."""

from tarnline.plans import control, evolution, population, report, search, terrain  # noqa: F401
from tarnline.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
