import os

import __spark_entry__ as entry
import pytest

from kinfold.session import cut, release, scope, tables_root

SF = "/root/testdata/sf0.001"


def tables(spark):
    root = tables_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["cluster_default", "cluster_blocked", "p1_found", "p2_found", "sample_evenly", "stream_assign", "partition_roundtrip", "bfs_from_hub"])
def test_no_table_is_left_behind_a_query(spark, name):
    before = tables(spark)
    with scope(spark):
        assert entry.queries()[name](spark, SF).count() >= 0
        assert tables(spark) - before
    assert tables(spark) == before


def test_release(spark):
    before = tables(spark)
    t = cut(spark.range(3))
    assert t.count() == 3 and len(tables(spark) - before) == 1
    release(t)
    release(t)
    release(None)
    assert tables(spark) == before
