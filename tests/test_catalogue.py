import pytest

from axisflow.plans import catalogue
from tests.compare import oracle, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(catalogue.queries()[name](spark, SF).toPandas(), oracle(SF, catalogue.oracle_sql()[name]))


def test_every_query_has_sql_or_is_iterative():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"gbdt_train_predict"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
