"""Registered queries against their SQL on the smallest tables.

By default one query per family runs; QUEUEMILL_ALL=1 runs every query that has SQL.
"""

import os

import pytest
from compare import differences, duck, duck_rows, spark_rows

from queuemill.plans.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
FAMILIES = """team_workload current_state journey ticket_actions apply_decisions open_tickets clean_text raw_text screening_audit
corpus_profile context_blocks decision_summary promote_new stratified_split tfidf lexical_topk category_topk choose_blend
merge_near_fixes rank_fixes argmax_class majority_vote abstention_curve clf_metrics mcnemar_exact bootstrap_ci tune_k
scan_decision_log export_findings_json intake stream_ticket_state stream_decision_summary""".split()
CHOSEN = sorted(CHECKS) if os.environ.get("QUEUEMILL_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert differences(spark_rows(QUERIES[name](spark, SF)), duck_rows(con, CHECKS[name])) is None


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)
