from pathlib import Path

import pytest

from compare import connect, same
from folioflow.llm import queries

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLE:
        equal, said = same(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE[name])
        assert equal, said
    else:
        queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
