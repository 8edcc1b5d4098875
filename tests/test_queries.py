"""Every core query against its DuckDB oracle; those without one against properties or fixtures in test_operators.py."""

import pytest

from adjudica import bind
from adjudica import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(name, same_as_oracle):
    same_as_oracle(core.queries()[name], core.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["review_plan", "text_diffs", "production_files", "context_selection", "cycle_paths", "lru_replay", "fifo_replay"])
def test_runs(name, spark):
    assert core.queries()[name](spark, DATA).count() > 0


def test_hunks_of_every_order(spark, duck):
    want = duck.sql("select count(*) from (select distinct l_suppkey, o_orderdate from lineitem join orders on l_orderkey = o_orderkey)").fetchall()[0][0]
    assert bind.hunks(spark, DATA).count() == want
