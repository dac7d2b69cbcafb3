"""Every registered query against its SQL, or at least its columns, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = {n: q for n, q in entry.queries().items() if not q.__module__.startswith("sedimenta.llm")}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in CORE}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    df = CORE[name](spark, SF)
    if name in SQL:
        same, extra, missing, _ = oracle.compare(df, SQL[name], con)
        assert same and not extra[:3] and not missing[:3]
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
