import os

import pytest

from sparkgrid.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, duck, same_rows  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])
