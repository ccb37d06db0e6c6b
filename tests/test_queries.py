from pathlib import Path

import pytest

import __spark_entry__
from compare import connect, same
from folioflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, con, name):
    equal, said = same(spark, con, FOLDER, registry.QUERIES[name], registry.ORACLE[name])
    assert equal, said


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
