"""Registered queries against their SQL twins on the smallest data.

The full list takes a while; by default one query per family runs.  DOMLAKE_ALL=1 runs all, as does
``python tests/compare.py <sf_dir>``.
"""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SOME = """x1_normalize_text u4_sanitize_url s2_html_to_dom t7_text_content t34_compile q8_score_match
q13_suggest_refinements q19_relink_stale d5_registry_update d14_compute_diff l2_layer_stack
l15_render_captures f3_cluster_inputs f14_form_state f20_observed_effect o4_action_windows
o14_link_observations n1_assemble_calls n11_inflight n12_network_quiet r2_tool_token_report
r6_shared_step_combos""".split()
NAMES = sorted(entry.queries()) if os.environ.get("DOMLAKE_ALL") else SOME


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    df, sql = entry.queries()[name](spark, data), entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, note = compare(df, con, sql)
    assert ok, note


def test_names_and_twins():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all("the" in r.label.lower() for r in rows)
