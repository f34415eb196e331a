from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import importing, quality, summaries
from vellum.streaming import imports

ITEM = "id string, book_code string, chapter int, verse string, content_type string, sequence_no int, semantic_key string, match_key string, logical_key string, language_code string, language_role string, resource_role string, protection_level string, review_status string, current_text string, raw_text string, source_locator string, created_at int"


def _items(spark, *rows):
    base = {"id": "a", "book_code": "MAT", "chapter": 1, "verse": "1", "content_type": "scripture", "sequence_no": 1, "semantic_key": "k", "match_key": None, "logical_key": None, "language_code": "en", "language_role": "source", "resource_role": "source_scripture", "protection_level": "normal", "review_status": "unreviewed", "current_text": "", "raw_text": None, "source_locator": "line:1", "created_at": 1}
    full = [base | r for r in rows]
    full = [r | {"match_key": r["match_key"] or r["semantic_key"], "logical_key": r["logical_key"] or f"{r['resource_role']}|{r['language_code']}|{r['semantic_key']}"} for r in full]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in full], ITEM)


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    f = lambda fn, x, *more: _one(spark, fn(F.col("c"), *more), c=x)
    assert f(T.normalize, "  é​  x﻿\n y ") == "é x y"
    assert f(T.unescape_xml, "&lt;a&gt; &amp;quot; &apos;") == "<a> \" '"
    assert f(T.strip_markers, 'word|strong="G1"\\w* more') == "word"
    assert f(T.strip_notes, "a \\f + b\\f* c \\x open") == "a c"
    assert f(T.numbers, "௧/௨ and 3 : 4 – 5, 1.5") == ["1/2", "3:4-5", "1", "5"]
    assert f(T.marker_sequence, "\\Fq x\\fq* \\1") == ["fq", "fq*"]
    assert f(T.words, "\\p Café au-lait 3") == ["Café", "au", "lait"]
    assert f(T.clean_cell, " n/a ") == "" and f(T.clean_cell, "a \n  b") == "a\nb"
    assert f(T.whole_number, "-12") == -12 and f(T.whole_number, "1a") is None and f(T.whole_number, "99999999999") is None
    assert f(T.code_points, "a​b⁠", quality.INVISIBLE) == ["U+200B", "U+2060"]


def test_record_rules(spark):
    items = _items(spark, {"id": "1", "current_text": "bad �\u0001​ é", "raw_text": "\\f + note", "chapter": 29}, {"id": "2", "semantic_key": "k2", "raw_text": "\\ fq x \\ft *"}, {"id": "3", "book_code": "XXX", "chapter": 999, "semantic_key": "k3"})
    found = {(r.content_item_id, r.category) for r in quality.record_findings(items).collect()}
    assert found == {("1", c) for c in ("unicode_zero_width", "unicode_replacement_character", "invalid_control_character", "unicode_normalization", "usfm_marker_balance", "invalid_chapter_anchor")} | {("2", "usfm_marker_spacing")}


def test_pair_rules(spark):
    target = {"language_role": "target", "language_code": "ta", "resource_role": "target_scripture"}
    note = {"content_type": "study_note", "resource_role": "study_notes"}
    items = _items(
        spark,
        {"id": "s1", "current_text": "Value 1/16"}, {"id": "t1", "current_text": "Value 1/64", **target}, {"id": "t2", "semantic_key": "k2", **target},
        {"id": "s3", "semantic_key": "k3", **note, "current_text": "Source", "raw_text": "\\fq word\\fq*"}, {"id": "t3", "semantic_key": "k3", **target, **note, "current_text": " ", "raw_text": "\\fq word"},
        {"id": "s4", "semantic_key": "k4", "current_text": "2 and 1"}, {"id": "t4", "semantic_key": "k4", "current_text": "1, 2", **target},
    )
    found = {(r.content_item_id, r.paired_content_item_id, r.category) for r in quality.pair_findings(items).collect()}
    assert found == {("t1", "s1", "number_mismatch"), ("t2", None, "versification_difference"), ("t3", "s3", "empty_target_content"), ("t3", "s3", "usfm_marker_sequence_mismatch")}


def test_duplicates_and_lifecycle(spark):
    items = _items(spark, {"id": "1", "match_key": "m"}, {"id": "2", "match_key": "m", "semantic_key": "k2"}, {"id": "3", "match_key": "m", "semantic_key": "k3", "language_code": "ta", "language_role": "target", "resource_role": "source_scripture"})
    dup = quality.duplicate_findings(items).collect()
    assert [(r.content_item_id, r.category) for r in dup] == [("1", "duplicate_canonical_record")]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in quality.COLUMNS if c != "confidence") + ", confidence double, engine string, status string")
    first = quality.next_issues(none, items)
    assert first.count() == quality.findings(items).count() > 0
    closed = quality.set_status(first, dup[0].fingerprint, "rejected")
    again = quality.next_issues(closed, items).filter(F.col("fingerprint") == dup[0].fingerprint).collect()
    assert [r.status for r in again] == ["rejected"]
    assert {r.severity: r.n for r in quality.summary(quality.findings(items)).collect()}["critical"] == 0


def _hashed(df):
    return df.withColumn("content_hash", T.content_hash(F.col("current_text")))


def test_classification(spark):
    note = {"content_type": "footnote", "match_key": "n"}
    existing = _hashed(_items(spark, {"id": "e1", "current_text": "Original", "protection_level": "protected_scripture"}, {"id": "e2", "semantic_key": "f", **note, "current_text": "Old"}))
    incoming = _hashed(
        _items(
            spark,
            {"id": "i1", "current_text": "Changed"}, {"id": "i2", "current_text": " Original "}, {"id": "i3", "semantic_key": "new", "current_text": "x", "sequence_no": 1}, {"id": "i4", "semantic_key": "new", "current_text": "x", "sequence_no": 2},
            {"id": "i5", "semantic_key": "new", "current_text": "y", "sequence_no": 3}, {"id": "i6", "semantic_key": "g", **note, "resource_role": "footnotes", "current_text": "New"}, {"id": "i7", "semantic_key": "h", **note, "resource_role": "study_notes", "current_text": "New"},
        )
    )
    got = {r.id: (r.status, r.anchor_id, r.recommendation) for r in importing.classify(incoming, existing).collect()}
    assert got == {
        "i1": ("conflict", "e1", "manual_review"), "i2": ("identical", "e1", None), "i3": ("new", None, None), "i4": ("identical", "i3", None),
        "i5": ("conflict", "i3", "manual_review"), "i6": ("conflict", "e2", "use_incoming"), "i7": ("new", None, None),
    }
    preview = importing.summarize(importing.classify(incoming, existing, within=False)).first()
    assert (preview.new_items, preview.exact_items, preview.changed_items, preview.overlaps) == (4, 1, 2, 1)
    inserted, conflicts = importing.commit(incoming, existing)
    assert sorted(r.id for r in inserted.collect()) == ["i3", "i7"] and conflicts.count() == 3


def test_resolution(spark):
    existing = _hashed(_items(spark, {"id": "e1", "current_text": "Old", "protection_level": "protected_scripture"}, {"id": "e2", "semantic_key": "b", "content_type": "footnote", "current_text": "Old"}))
    incoming = _hashed(_items(spark, {"id": "i1", "current_text": "New"}, {"id": "i2", "semantic_key": "b", "content_type": "footnote", "current_text": "New"}))
    conflicts = importing.commit(incoming, existing)[1]
    ids = {r.anchor_id: r.conflict_id for r in conflicts.collect()}
    versions = spark.createDataFrame([("e2", 4, "Older", "manual_merge", "r")], "content_item_id string, revision_no int, text string, change_type string, reason string")

    def decide(*rows):
        return importing.resolve(conflicts, existing, versions, spark.createDataFrame(list(rows), "conflict_id string, action string, reason string, merged_text string, confirm_protected boolean"))

    refused = decide((ids["e1"], "use_incoming", "why", None, None), (ids["e2"], "manual_merge", " ", "x", None), ("nope", "keep_existing", None, None, None), (ids["e2"], "burn", None, None, None))[3]
    assert sorted(r.error for r in refused.collect()) == ["a reason is required", "conflict not found", "invalid action", "protected text needs confirmation"]
    items, after, history, refused = decide((ids["e1"], "keep_existing", None, None, None), (ids["e2"], "use_incoming", "why", None, None))
    assert {r.id: (r.current_text, r.review_status) for r in items.collect()} == {"e1": ("Old", "unreviewed"), "e2": ("New", "needs_review")}
    assert {r.conflict_id: r.status for r in after.collect()} == {ids["e1"]: "keep_existing", ids["e2"]: "use_incoming"}
    assert [(r.revision_no, r.text) for r in history.filter("change_type = 'use_incoming'").collect()] == [(5, "Old")] and refused.count() == 0
    # the stored hash is that of the text, so importing the accepted text again is no conflict
    assert importing.classify(_hashed(_items(spark, {"id": "i9", "semantic_key": "b", "content_type": "footnote", "current_text": "New"})), items).first().status == "identical"


def test_language_resolution(spark):
    df = spark.createDataFrame([(None, "target_scripture", None), (None, "notes", "en"), ("target", "notes", "en"), (None, "notes", ""), (None, "notes", "xx")], "language_role string, resource_role string, file_language string")
    got = [(r.language_role, r.language_code) for r in importing.resolve_language(df, "en", "ta").collect()]
    assert got == [("target", "ta"), ("source", "en"), ("target", "ta"), (None, None), (None, "xx")]


def test_new_files(spark):
    files = spark.createDataFrame([(b"x", "a", None), (b"x", "b", None), (b"y", "a", "")], "content binary, resource_role string, language_code string")
    known = files.filter("resource_role = 'a' AND content = X'78'").withColumn("sha256", F.sha2("content", 256)).withColumn("language_code", F.lit(""))
    assert sorted((bytes(r.content), r.resource_role) for r in importing.new_files(files, known).collect()) == [(b"x", "b"), (b"y", "a")]


def test_summaries(spark):
    items = _items(spark, *[{"id": str(i), "sequence_no": i, "semantic_key": str(i), "current_text": "b a B", "chapter": i % 3 or None, "protection_level": "protected_scripture" if i % 2 else "normal"} for i in range(9)])
    assert summaries.totals(items).first().protected == 4
    assert [(r.word, r.n) for r in summaries.vocabulary(items, "en", 3).collect()] == [("B", 9), ("a", 9), ("b", 9)]
    assert [r.word for r in summaries.vocabulary(items, "en", 3, locale=True).collect()] == ["a", "b", "B"]
    assert [r.id for r in summaries.browse(items, limit=2, offset=3, book_code="MAT").collect()] == ["1", "4"]
    rules = spark.createDataFrame([("x", "draft", 9), ("y", "approved", 1)], "name string, status string, evidence_count int")
    assert [r.name for r in summaries.listed_rules(rules, "name").collect()] == ["y", "x"]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "A  b", "t", 1.0), ("2024-01-01 00:00:02", " A b", "t", 2.0), ("2024-01-01 02:00:00", "c", "u", 3.0)]
    spark.createDataFrame(rows, "ts string, current_text string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, current_text string, event_type string, value double").parquet(str(tmp_path / "in"))
    imports.append_to(imports.first_seen(imports.hashed(stream())), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    imports.append_to(imports.activity(stream()), str(tmp_path / "agg"), str(tmp_path / "c2")).awaitTermination(60)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "agg")).collect()] == [2]


def test_bilingual_rows_are_numbered_by_ranges(spark):
    from vellum.sinks import exchange

    rows = spark.range(3000).selectExpr("CAST(id * 7919 % 1000 AS INT) AS seq", "CAST(id AS STRING) AS key")
    got = exchange.numbered(rows, "seq", "key")
    want = sorted((r.seq, r.key) for r in rows.collect())
    assert [(r.seq, r.key, r.no) for r in sorted(got.collect(), key=lambda r: r.no)] == [(s, k, n + 1) for n, (s, k) in enumerate(want)]
    assert exchange.numbered(rows.limit(0), "seq", "key").count() == 0
    plan = exchange.numbered(rows, "seq", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert all("[_part" in x for x in plan.split("\n") if "row_number()" in x)
