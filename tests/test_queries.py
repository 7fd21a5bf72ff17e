import pytest
from oracles import compare, connection

from sigloom import model_queries, queries  # noqa: F401

SLOW = {"linear_svm_folds", "random_forest_folds", "gradient_boosting_folds", "isotonic_folds", "sigmoid_folds", "personalisation", "ablation_folds"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - SLOW))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_registers_every_reference_query():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_entry_runs(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
