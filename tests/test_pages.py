"""Pages by directory against OFFSET."""

from __future__ import annotations

import random

import pytest

from vellum.operators import pages, summaries


def test_pages_equal_offset(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"i{k}", rng.choice([None, "GEN", "MAT", "REV"]), rng.choice([None, 1, 2, 3]), rng.randrange(300), k) for k in range(1500)]
    items = spark.createDataFrame(rows, "id string, book_code string, chapter int, sequence_no int, n int")
    path = (tmp_path / "pages").as_uri()
    pages.write(items, path, size=100)
    ranges = spark.read.parquet(f"{path}/directory").count()
    assert 10 <= ranges <= 15
    for offset in (0, 1, 99, 700, 1490, 1500, 10**6):
        got = pages.page(spark, path, 30, offset)
        want = summaries.browse(items, limit=30, offset=offset)
        assert [r.id for r in got.collect()] == [r.id for r in want.collect()]
        assert len(got.inputFiles()) <= 3  # of all ranges, those of the page
    with pytest.raises(ValueError):
        pages.page(spark, path, 0)


def test_no_items(spark, tmp_path):
    path = (tmp_path / "none").as_uri()
    pages.write(spark.createDataFrame([], "id string, book_code string, chapter int, sequence_no int"), path)
    assert pages.page(spark, path).collect() == []
