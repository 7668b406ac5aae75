import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
