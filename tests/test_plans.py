"""Physical plans: what reaches the scans, and how often rows are shuffled."""

import re

import pytest

import oracle
from cohortsmith.queries import QUERIES

pytestmark = pytest.mark.skipif(not oracle.THERE, reason="no tables")


def plan(spark, name):
    return QUERIES[name](spark, oracle.FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scans(spark):
    text = plan(spark, "and_group")
    assert "EqualTo(l_returnflag,R)" in text and "GreaterThan(l_quantity,45.0)" in text and "EqualTo(o_orderpriority,1-URGENT)" in text
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert "l_orderkey:bigint,l_quantity:double,l_returnflag:string" in schemas and not any("p_brand" in s for s in schemas)


@pytest.mark.parametrize("name", ["and_group", "n_among_m", "nested_groups", "exclusion", "or_with_complement"])
def test_a_tree_without_constraints_is_one_aggregation(spark, name):
    """The lookups' joins aside, rows are dealt by subject once, whatever the number of criteria."""
    text = plan(spark, name)
    assert len(re.findall(r"hashpartitioning\(subject", text)) == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_runs_in_python_or_as_a_product(spark, name):
    text = plan(spark, name)
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|CartesianProduct", text)
