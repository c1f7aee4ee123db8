"""Registered queries over the given tables and the SQL that checks them."""

from .registry import ORACLES, QUERIES

from . import advice, coverage, departures, feed, fleet, headway, reports, streams  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
