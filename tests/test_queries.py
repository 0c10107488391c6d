"""Every catalogue query against its SQL twin on the smallest tables; those without a twin by a property."""

from __future__ import annotations

import pytest

from caseflow.plans import catalogue
from tests import oracle
from tests.session import SMALL

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert oracle.differences(catalogue.queries()[name](spark, SMALL), con, SQL[name]) == []


def test_queries_without_sql(spark):
    q = catalogue.queries()
    assert set(q) - set(SQL) == {"greedy_frame_selection", "restatement_pairs", "degraded_observations", "stream_detector", "candidate_selection", "probe_scores"}
    chosen = q["greedy_frame_selection"](spark, SMALL).groupBy("case_id").count().collect()
    assert chosen and {r["count"] for r in chosen} == {8}
    n = q["frame_ordinals"](spark, SMALL).count()
    assert 0.7 * n < q["degraded_observations"](spark, SMALL).count() < 0.9 * n


def test_stream_equals_batch(spark):
    q = catalogue.queries()
    streamed = {tuple(r) for r in q["stream_detector"](spark, SMALL).select("case_id", "label", "t_ms", "onset_ms", "type").collect()}
    batch = {(*[r[c] for c in ("case_id", "label", "t_ms", "onset_ms")], kind) for kind, name in (("entered", "hysteresis_entries"), ("left", "hysteresis_exits")) for r in q[name](spark, SMALL).collect()}
    assert streamed == batch


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
