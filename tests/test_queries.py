"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vellum import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    want = db.execute(registry.oracle_sql()[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows([c[0] for c in want.description], want.fetchall())


def test_every_rule_finds_something(spark):
    found = {r.category for r in registry.queries()["qa_issues"](spark, "/root/testdata/sf0.01").select("category").distinct().collect()}
    assert len(found) == 12


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.queries()["vocabulary_locale"](spark, SF).count() == 80
