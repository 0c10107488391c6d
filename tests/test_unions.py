"""Unions of inputs that are shuffled alike, as joins of large tables leave them."""

import re

import __spark_entry__ as entry
from caseflow.plans import lineage_queries
from tests import oracle
from tests.session import SMALL


def test_turn_rules_without_broadcasts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = entry.queries()["turn_rules"](spark, SMALL)
        assert oracle.differences(out, oracle.connect(SMALL), entry.oracle_sql()["turn_rules"]) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_turn_rules_deals_rows_by_order_and_customer_only(spark, tmp_path, monkeypatch):
    """The rows of manifests, some thirty times the orders, stay where their customer is; odd keys keep the result."""
    con = oracle.connect(SMALL)
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE o_orderkey END AS o_orderkey) FROM orders) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    monkeypatch.setattr(lineage_queries, "LINES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entry.queries()["turn_rules"](spark, SMALL)
        dealt = set(re.findall(r"hashpartitioning\((.*), \d+\)", out._jdf.queryExecution().executedPlan().toString()))
        assert {re.sub(r"#\d+L?", "", keys) for keys in dealt} == {"o_custkey", "o_orderkey", "l_orderkey"}
        assert oracle.differences(out, con, entry.oracle_sql()["turn_rules"]) == []
        odd = entry.queries()["turn_rules"](spark, str(tmp_path))
        assert oracle.differences(odd, oracle.connect(str(tmp_path)), entry.oracle_sql()["turn_rules"]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
