"""A sample of registered queries against their SQL; the driver checks all of them."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

SAMPLE = [
    "a1_capture_scan", "b04_capability_names", "b17_event_detail", "c1_watched_paths", "d01_lineage",
    "d02_state_as_of", "e19_shell_from_network_daemon", "f02b_every_evaluation", "g01_emission",
    "j02_lineage_sequence", "l4_investigate_risk", "f13_sweep_report", "i03_triage_merge",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, message = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 219
