"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import pytest

from partwatch.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# One query per area; tests/compare.py runs all of them.
CHOSEN = (
    "u_01_npm_sections",
    "s_04_clean_range",
    "a_05_recommendation",
    "j_22_first_repository",
    "w_06_newest_majors",
    "w_09_category_header",
    "snk_08_replace_cycles",
    "j_13_line_rules",
    "w_04_enclosing_construct",
    "w_11_taint_state",
    "j_20_corroboration",
    "w_10_finding_numbers",
    "n_06_trivy",
    "j_12_plugin_version",
    "w_12_first_breach",
    "snk_03_report_csv",
    "snk_04_report_lines",
    "snk_04_text_lines",
    "snk_05_report_json",
    "s_31_project_texts",
    "t_03_upsert",
    "t_04_latest_stream",
    "snk_07_upsert_npm",
    "snk_08_refresh_catalogue",
    "j_06_failed_lookup",
    "j_17_flow_controls",
    "o_02_risk_order",
    "t_02_fresh_lookups",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches(spark, duck, name):
    text, good = compare(spark, duck, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert good, text


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
