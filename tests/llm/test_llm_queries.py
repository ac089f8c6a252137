"""Registered operator queries that SQL can express give the rows of their SQL."""

import pytest
from compare import same_rows
from conftest import DATA

from alleloom.llm.oracles import ORACLES
from alleloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_the_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), ORACLES[name], DATA)
