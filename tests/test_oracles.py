"""A few registered queries against their SQL on the smallest supplied tables."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no supplied tables")

NAMES = ["page_label", "wording", "escape_md", "path_cleaning", "carried", "reconcile", "corpus_hash", "latest_run"]
NAMES += ["fold_decision_log", "decided_blocks", "selection_toggle", "latest_decisions"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return db


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SMALL)
    want = duck.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
