"""Every query outside the llm subpackage runs, and equals its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import connect, same  # noqa: E402

from tessera.plans import detail_queries, edit_queries, search_queries, signature_queries, structure_queries, table_queries, text_queries  # noqa: E402,F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


#: Queries whose thresholds are not met in the smallest tables.
LARGER = {"tag_filter": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    folder = LARGER.get(name, FOLDER)
    con = connect(folder) if name in LARGER else con
    df = QUERIES[name](spark, folder)
    same(df, con, ORACLES[name])
    assert df.limit(1).count(), "an empty result proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "effect_id"] and 0 < df.count() <= 20
