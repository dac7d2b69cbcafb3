"""The problems' queries against SQL on the smallest tables."""

import oracle
import pytest

from sedimenta.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same, extra, missing, _ = oracle.compare(queries()[name](spark, SF), oracle_sql()[name], oracle.connect(SF))
    assert same and not extra and not missing


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
