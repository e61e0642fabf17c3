"""Queries with SQL give the rows of their SQL; all queries run on whole tables and have the promised columns."""
import pytest

import __spark_entry__ as entry
from compare import check, connect
from nocturne.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NATIVE = ["op1_line_dedup", "op3_url_filters", "op6_chat_formatting"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert check(spark, connect(SF), QUERIES[name], SQL[name], SF) == ""


def test_entry_has_all():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
