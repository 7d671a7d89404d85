"""Every registered query against its SQL counterpart on whole tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3 * 8 + 2 * 2


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for plan in (entry.scoring, entry.evaluation, entry.labeling, entry.text, entry.pages, entry.works, entry.files, entry.features)
           for name in plan.QUERIES}
    assert own <= set(entry.oracle_sql())
