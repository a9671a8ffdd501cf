"""Each registered library query gives what its SQL gives."""

import pytest
from conftest import SMALL, rows_of

from tessera.jobs import governance, governance_sql, knowledge, knowledge_sql, oracles
from tessera.jobs import queries as library

ORACLE_SQL = oracles.ORACLE_SQL | governance_sql.ORACLE_SQL | knowledge_sql.ORACLE_SQL


def queries():
    return library.queries() | governance.queries() | knowledge.queries()


#: Their patterns look around, and excerpts are folds: compared with brute force in test_records.py.
WITHOUT_SQL = {"masking_report", "fully_protected_documents", "focused_excerpts"}


def test_all_have_sql():
    assert set(queries()) == set(ORACLE_SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["project", "path", "line_start", "rank", "score", "n_chars"]
