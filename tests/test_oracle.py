"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import difference, tables

FOLDER = "/root/testdata/sf0.001"

# Fifteen users leave some calendar blocks without buyers, where a ranking score is not a number.
UNDEFINED = {"m14_block_scores"}


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    # The text operators return nulls where their tables say so (no rule fits, no law applies).
    assert name in UNDEFINED or name.startswith("op") or not got.isna().any().any()
    if name in entry.oracle_sql():
        assert difference(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
