"""Staged and published batches."""

from __future__ import annotations

import pytest

from vellum.operators import batches, importing

FILES = "file_id string, batch_id string, filename string, format string, sha256 string, byte_size long, language_code string, resource_role string"
ITEM = "id string, file_id string, resource_id string, book_code string, logical_key string, match_key string, language_code string, language_role string, resource_role string, content_type string, content_hash string, sequence_no int, protection_level string, current_text string, raw_text string, source_locator string"


def items(spark, file, rows):
    return spark.createDataFrame([(f"{file}-{k}", file, f"r{file}", "GEN", f"notes|en|{key}", f"M{key}", "en", "source", "notes", "footnote", text, k, "normal", text, text, f"line:{k}") for k, (key, text) in enumerate(rows)], ITEM)


def files(spark, *names):
    return spark.createDataFrame([(n, "b", f"{n}.sfm", "usfm", f"sha-{n}", 10, "en", "notes") for n in names], FILES)


def state(spark, root, schema):
    return {r.logical_key: r.current_text for r in batches.read(spark, root, "items", schema).collect()}


def test_batches_are_published_whole_or_not_at_all(spark, tmp_path):
    root = (tmp_path / "project").as_uri()
    first = batches.stage(root, files(spark, "f1"), items(spark, "f1", [("a", "one"), ("b", "two"), ("a", "three")]), 1)
    schema, of_conflicts, of_batches = (first.table(spark, name).schema for name in ("items", "conflicts", "batches"))
    assert batches.published(spark, root) == 0  # a job that ends here leaves nothing behind
    assert state(spark, root, schema) == {}
    shown = batches.preview(spark, first).first()
    assert (shown.new_items, shown.exact_items, shown.changed_items, shown.new_files, shown["bytes"]) == (2, 0, 1, 1, 10)
    rival = batches.stage(root, files(spark, "f2"), items(spark, "f2", [("b", "two"), ("c", "four")]), 2)
    assert batches.publish(spark, first) == 1
    assert state(spark, root, schema) == {"notes|en|a": "one", "notes|en|b": "two"}
    with pytest.raises(batches.StaleBatch):  # it was classified before the first one was there
        batches.publish(spark, rival)
    assert state(spark, root, schema) == {"notes|en|a": "one", "notes|en|b": "two"}
    again = batches.stage(root, files(spark, "f2", "f1"), items(spark, "f2", [("b", "two"), ("c", "four"), ("a", "five")]).union(items(spark, "f1", [("x", "left out")])), 3)
    shown = batches.preview(spark, again).first()
    assert (shown.new_items, shown.exact_items, shown.changed_items, shown.new_files) == (1, 1, 1, 1)  # the bytes of f1 are known
    assert batches.publish(spark, again) == 2
    assert state(spark, root, schema) == {"notes|en|a": "one", "notes|en|b": "two", "notes|en|c": "four"}
    conflicts = batches.read(spark, root, "conflicts", of_conflicts).collect()
    assert {(r.incoming_id, r.anchor_id) for r in conflicts} == {("f1-2", "f1-0"), ("f2-2", "f1-0")}
    assert {(r.batch_id, r.inserted, r.skipped, r.changed) for r in batches.read(spark, root, "batches", of_batches).collect()} == {("b", 2, 0, 1), ("b", 1, 1, 1)}
    with pytest.raises(batches.StaleBatch):
        batches.publish(spark, again)


def test_what_is_published_is_what_classify_gives(spark, tmp_path):
    root = (tmp_path / "same").as_uri()
    rows = items(spark, "f1", [(f"k{k % 7}", f"t{k % 3}") for k in range(30)])
    staged = batches.stage(root, files(spark, "f1"), rows, 1)
    empty = rows.selectExpr("*", "1L AS created_at").limit(0)
    want = sorted(map(tuple, importing.classify(rows, empty).collect()), key=repr)
    assert sorted(map(tuple, staged.table(spark, "classified").collect()), key=repr) == want
