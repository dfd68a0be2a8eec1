import pytest

from mnemora.plans import catalogue
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, name):
    check(spark, sf, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.toPandas() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_reads_only_what_it_needs(spark, sf):
    """The vector column is in no text plan, and filters reach the scan."""
    df = catalogue.QUERIES["decay_patterns"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "text" not in plan.split("ReadSchema")[-1]


def test_greedy_pool(spark):
    """A dropped row suppresses nobody: b is close to a, c is close to b only."""
    from mnemora.operators.vectors import keep_distinct

    rows = [(1, 1, 10, [1.0, 0.0]), (1, 2, 11, [0.8, 0.6]), (1, 3, 12, [0.28, 0.96]), (1, 4, 13, None), (1, 5, 14, [1.0, 0.001])]
    df = spark.createDataFrame(rows, "query_id long, pos int, id long, embedding array<double>")
    got = {r["id"] for r in keep_distinct(df, 0.79).collect()}
    assert got == {10, 12, 13}
