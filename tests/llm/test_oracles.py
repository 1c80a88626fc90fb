import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexweft import llm  # noqa: E402
from oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, SF, llm.queries()[name], llm.oracle_sql()[name])


def test_all_queries_are_registered():
    names = llm.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
