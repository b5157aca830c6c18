"""Registered queries and their SQL."""

from . import basket_plans, desk_plans, more_plans, point_in_time, rule_plans, scores, series, source_plans, supply_plans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
