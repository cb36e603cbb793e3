"""Every query that SQL can express against DuckDB; the others run and are looked at elsewhere."""

import pytest
from compare import assert_same

from siltstone import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(name, spark, duck, sf_dir):
    assert_same(catalog.QUERIES[name], catalog.ORACLES[name], spark, duck, sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_jvm(spark, sf_dir, capsys):
    for name in ("f1_f5_rule_list", "f8_j1_sync", "a1_dedup_stats", "p2_p3_windows", "x6_hmac", "r1_bloom"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
