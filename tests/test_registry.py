import pytest

import __spark_entry__ as entry
from labelloom import registry
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Model training has no SQL; tests/test_models.py checks it on fixtures.
WITHOUT_SQL = {"tfidf_lr", "mlp_head", "cv_report"}


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_sql_or_a_reason():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "y", "n"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, database, name):
    assert compare(spark, database, name, SF_DIR) is None
