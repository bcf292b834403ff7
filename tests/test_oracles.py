"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from vicinal.catalog.oracles import ORACLES
from vicinal.catalog.queries import REGISTRY

QUERIES, SQL = REGISTRY, ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(QUERIES[name], SQL[name], spark, con, sf_dir) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 100


def test_no_all_pairs_joins(spark, sf_dir):
    for name in ("knn_cosine", "knn_pruned", "standardize", "prompts", "classification_report", "sweep_k"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
