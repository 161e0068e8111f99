"""Every query of the library against its SQL on the smallest tables."""

import os

import pytest

from rankloom.plans import queries
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
