"""Registered queries and their SQL counterparts."""

from . import aggregates, almanac, arrays, calibrate, feeds, filters, joins, live, ordering, physics, registration, satellites, tables_dml
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "almanac", "arrays", "calibrate", "feeds", "filters", "joins", "live", "ordering", "physics", "registration", "satellites", "tables_dml"]
