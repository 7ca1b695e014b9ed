import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_catalog import ROOT, compare, connect  # noqa: E402

from threadloom.llm.queries import QUERIES  # noqa: E402
from threadloom.llm.sql import ORACLE  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        compare(spark, connect(), QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, ROOT).count() > 0
