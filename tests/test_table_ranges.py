"""Delimited files cut into lines over many tasks, against the reader that takes a file in one go."""

from __future__ import annotations

import json
import random

import pytest

from vellum.dims import HEADERS
from vellum.sources import ranges, tables

SHOWN = ["file", "sequence_no", "semantic_key", "match_key", "book_code", "chapter", "verse", "content_type", "marker", "current_text", "raw_text", "source_locator", "warning"]


def random_table(rng, delimiter, rows, broken):
    """Cells with quotes anywhere, doubled quotes, delimiters and all kinds of line ends inside and outside of them."""
    end = lambda: rng.choice(["\n", "\n", "\r\n", "\r"])
    text = rng.choice(["", "﻿"]) + rng.choice([delimiter.join(HEADERS), delimiter.join(["Book", "Ch", "Vs", "text", "Tags", ""]), delimiter.join(["a", "b", "a"])]) + end()
    for _ in range(rows):
        cells = []
        for _ in range(rng.randrange(1, 8)):
            inner = "".join(rng.choice(["x", "7", " ", delimiter, "\n", "\r\n", "\r", '""', "é"]) for _ in range(rng.randrange(6)))
            cells.append(rng.choice(["", "", "3", "plain", f'"{inner}"', f'mid"{inner}"dle', '""']))
        text += delimiter.join(cells) + end()
    return text + ('"' if broken else "") + rng.choice(["", "last", "\n\n"])


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(21)
    return {f"f{k}": random_table(rng, ",", n, k % 4 == 3) for k, n in enumerate([0, 1, 2, 5, 20, 40, 40, 80, 80, 120])} | {"empty": "", "blank": "\n\r\n\n"}


def shown(items):
    return sorted(map(tuple, items.select(*SHOWN).collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark, contents):
    files = spark.createDataFrame([(k, v.encode()) for k, v in contents.items()], "file string, content binary")
    return files, shown(tables.parse_delimited(files))


@pytest.mark.parametrize("size", [1, 5])
def test_any_number_of_ranges(spark, whole, size):
    files, want = whole
    assert len({r[0] for r in want if r[-1]}) > 1  # some files are unreadable
    assert shown(tables.parse_delimited(files, size=size, chars=-1)) == want


def test_a_file_read_in_splits(spark, tmp_path, contents, whole):
    for name, text in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = ranges.read_pieces(spark, str(tmp_path))
        assert lines.select("file", "range").distinct().count() > 20
        got = shown(tables.parse_delimited_lines(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted([(r[0].rsplit("/", 1)[1].removesuffix(".csv"), *r[1:]) for r in got], key=repr) == whole[1]


def random_json(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return rng.choice([None, True, 0, -1.5, "", "a", 'q"uote', "br}ace{", "[x]", "back\\slash", "tail\\", "é\n", 7])
    if rng.random() < 0.4:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["text", "semanticKey", "chapter", "items", "k}", "verse", "sequenceNo", 'x"', "matchKey"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture(scope="module")
def json_contents():
    rng = random.Random(31)
    record = lambda: rng.choice([{"text": "plain", "chapter": 3}, {"text": "b}", "semanticKey": 's"1'}, random_json(rng)])
    out = {}
    for k in range(60):
        records = [record() for _ in range(rng.randrange(12))]
        roots = [records, {"schemaVersion": 1, "items": records}, {"a": [1, [2]], "items": records, "count": 3}, {"items": records, "meta": {"x": {"y": 1}}}, {"meta": {"x": {"y": [{}]}}, "items": records}, {"items": {"text": "no list"}}, random_json(rng)]
        out[f"j{k:02}"] = json.dumps(roots[k % 7], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", "  \n"])
    broken = ["", "[", '[{"a":1', '[{"a":1}', '[{"a":1},]', '[,{"a":1}]', '[{"a":1} {"b":2}]', '{"items":[{"a":1}]', '{"items":[{"a":1}]}}', '[{"a":1}] x', "{}", "[]", "3", '"text"', '["only", "texts", 1]', '{"items":[{"text":"1"}],"items":[{"text":"2"}]}', '﻿[{"text":"mark"}]', '[{"a":"\\}"}]', '{"items":[{"text":"x"}],"n":1,}']
    return out | {f"x{k:02}": text for k, text in enumerate(broken)}


@pytest.mark.parametrize("size", [1, 20])
def test_json_in_any_number_of_ranges(spark, json_contents, size):
    files = spark.createDataFrame([(k, v.encode()) for k, v in json_contents.items()], "file string, content binary")
    plain = lambda items: [r if r[-1] is None else (r[0], "unreadable") for r in shown(items)]
    want = plain(tables.parse_json(files))
    assert len(want) > 150
    assert plain(tables.parse_json(files, size=size, chars=-1)) == want


def test_json_records_alone(spark):
    """An array of objects never comes together in one row."""
    text = json.dumps([{"text": f"t{k}", "inner": {"a": [{"b": k}]}} for k in range(50)])
    pieces = ranges.pieces_of(spark.createDataFrame([("f", text)], "file string, content string"), "}", 4)
    lengths = [len(r.text) for r in tables._json_chunks(pieces).collect()]
    assert len(lengths) == 51 and max(lengths) < 60


def test_a_json_file_read_in_splits(spark, tmp_path, json_contents):
    for name, text in json_contents.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    files = spark.createDataFrame([(k, v.encode()) for k, v in json_contents.items() if v], "file string, content binary")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = shown(tables.parse_json_pieces(ranges.read_pieces(spark, str(tmp_path), "}")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = lambda rows: sorted([r if r[-1] is None else (r[0], "unreadable") for r in rows], key=repr)
    assert plain((r[0].rsplit("/", 1)[1].removesuffix(".json"), *r[1:]) for r in got) == plain(shown(tables.parse_json(files)))


def test_bytes_that_are_no_text(spark):
    files = spark.createDataFrame([("a", b'[{"text":"x\xff"},{"text":"y"}]')], "file string, content binary")
    csv = spark.createDataFrame([("a", b"text,Book\nx\xff,MAT\n")], "file string, content binary")
    for chars in (1000, -1):
        assert [r.current_text for r in tables.parse_json(files, chars=chars).orderBy("sequence_no").collect()] == ["x\ufffd", "y"]
        assert [r.current_text for r in tables.parse_delimited(csv, chars=chars).collect()] == ["x\ufffd"]
