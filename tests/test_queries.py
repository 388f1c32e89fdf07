import pytest

from tests.compare import SMALL, differences
from tidemark.jobs import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_promotion_gate_at_its_threshold(spark, tmp_path):
    """Six discounts with a mean of exactly 0.025 are not above it, in whatever order they are added: 0.05 + 0.1 is more than 0.15 in doubles."""
    orders = {1: (0, 0, 0, 0, 0.05, 0.1), 2: (0.1, 0, 0, 0, 0, 0.05), 3: (0, 0, 0, 0, 0.06, 0.1)}
    rows = [(k, line, 10.0, float(x), 0.01) for k, discounts in orders.items() for x in discounts for line in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r["spec_id"] for r in queries.promotion_gate(spark, str(tmp_path)).collect()] == [3]
