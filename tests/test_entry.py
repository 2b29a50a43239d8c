"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import duck, expected, rows_of

SF = "/root/testdata/sf0.001"
CORE = (
    "last_answer refusals_by_reason funnel_row weekly_utility dedupe_exact_best drop_republications posting_rules"
    " candidate_pairs topk_per_profile pack_digest open_yesterday usage_budget judge_agreement upsert_winner"
    " retention_keep daily_repeats event_quality json_source_records text_flags"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("POSTMATCH_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, columns = rows_of(df.columns, df.collect())
    want, want_columns = expected(con, entry.oracle_sql()[name])
    assert columns == want_columns and got == want


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
