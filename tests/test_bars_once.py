"""Plans that read their bars several times read a written table, not the order lines again."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["alpha_012", "alpha_single", "sector_sum_zero"])
def test_order_lines_are_read_once(spark, name):
    df = entry.queries()[name](spark, SF)
    assert not [f for f in df.inputFiles() if "lineitem" in f] and df.count()
