"""Registered queries against their SQL on the smallest tables.

A selection by default; WAYFEED_ALL=1 runs all of them (minutes).
``check_queries.py`` does the same on larger tables.
"""

import os

import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from wayfeed.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SELECTION = """
    punctuality stop_lateness departures_enriched_shipments coverage_by_day data_gaps bunching_pairs bunching_by_stop
    snapshot_diff watchlist_reconcile report_rate_limit reports_vs_measured find_stops trip_advice_summer
""".split()
KEYS = sorted(QUERIES) if os.environ.get("WAYFEED_ALL") else SELECTION
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, key, monkeypatch):
    monkeypatch.setattr(check_queries, "SF_DIR", SF_DIR)
    problems = check_queries.compare(spark, check_queries.connect(SF_DIR), key, queries()[key], oracle_sql().get(key))
    problems = [p for p in problems if p != "empty result"]
    assert not problems or problems[0].startswith("ok"), problems
