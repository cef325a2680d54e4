"""The operators' queries against their oracle SQL; the native ones run no Python."""

import pytest

from popspark.llm import queries

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connect(sf))


@pytest.mark.parametrize("name", ["op7_secret_scan", "op8_decontaminate"])
def test_native_operators_run_no_python(spark, sf, name):
    text = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) < set(queries.queries())
