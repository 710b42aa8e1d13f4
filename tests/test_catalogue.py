"""Every query with SQL gives the same rows in Spark and in DuckDB; the others run."""

import pytest

import parity
from terrawing.plans import curation, inventory, survey

FOLDER = str(parity.DATA / "sf0.001")
QUERIES = survey.QUERIES | inventory.QUERIES | curation.QUERIES
SQL = survey.SQL | inventory.SQL | curation.SQL


def test_sql_belongs_to_a_query():
    assert len(QUERIES) == len(survey.QUERIES) + len(inventory.QUERIES) + len(curation.QUERIES)
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    ours, theirs = parity.differences(spark, QUERIES[name], SQL[name], FOLDER)
    assert not ours and not theirs, (list(ours)[:3], list(theirs)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
