"""Line-marker files cut into ranges, against a scanner that goes line by line."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from vellum.sources import markers, ranges

SHOWN = ["file", "book_code", "chapter", "verse", "content_type", "marker", "sequence_no", "semantic_key", "match_key", "parent_semantic_key", "source_locator", "raw_text", "warning"]
TYPES = {"id": "book_id", "c": "chapter", "v": "scripture", "p": "paragraph", "s1": "section_heading", "q": "poetry", "zz": "other"}


def scan(file, content):
    """The places and keys of the items, with a scanner's state."""
    book = chapter = verse = None
    out, ordinals = [], Counter()

    def add(kind, mark, at, verse, raw, parent=None, tail="", warning=None):
        scope = f"{book or 'UNK'}|{chapter or 0}|{verse or ''}|{kind}"
        if kind in ("scripture", "chapter", "book_id"):
            key = match = scope if kind == "scripture" else f"{book or 'UNK'}|{chapter or 0}|chapter" if kind == "chapter" else f"{book or 'UNK'}|book_id"
        else:
            narrow = f"{scope}|{mark or ''}|"
            key, match = f"{narrow}|{ordinals[narrow]}", f"{scope}|{ordinals[scope, 0]}"
            ordinals[narrow] += 1
            ordinals[scope, 0] += 1
        out.append((file, book, chapter, verse, kind, mark, len(out), key, match, parent, f"line:{at + 1}{tail}", raw, warning))
        return key

    for at, line in enumerate(re.split("\r?\n", content.removeprefix("\ufeff"))):
        if not line.strip():
            continue
        found = re.match(r"\\(\S+)(?:\s+(.*))?$", line.strip(), re.S)
        if not found:
            add("continuation", None, at, verse, line)
            continue
        mark, rest = found[1].removesuffix("*"), found[2] or ""
        body = rest
        if mark == "id":
            book = rest.split()[0].upper() if rest.split() else book
            add("book_id", mark, at, None, line)
            continue
        if mark == "c":
            number = re.match(r"\s*(-?\d+)", rest)
            chapter, verse = int(number[1]) if number else chapter, None
            add("chapter", mark, at, None, line)
            continue
        if mark == "v":
            parts = re.match(r"(\S+)\s*(.*)$", rest, re.S)
            verse, body = (parts[1], parts[2]) if parts else ("", "")
        parent = add(TYPES.get(mark, "other"), mark, at, verse, line)
        for kind, m, tail in (("footnote", "f", ":footnote"), ("cross_reference", "x", ":crossref")):
            for note in re.findall(rf"\\{m}(?=\s)(?:[\s\S]*?\\{m}\*|[\s\S]*$)", body):
                add(kind, m, at, verse, note, parent, tail, None if note.endswith(f"\\{m}*") else f"unclosed_{kind}")
    return out


def random_file(rng, n):
    lines = []
    for _ in range(n):
        note = rng.choice(["", "", r" \f + \ft a\f*", r" \x - b\x* tail", r" \f + open", r" \f + one\f* \f + two\f*"])
        lines.append(rng.choice([rf"\v {rng.randrange(4)} text{note}", rf"\v {rng.randrange(4)}", r"\v", rf"\c {rng.randrange(3)}", r"\c", r"\c x", rf"\id {rng.choice(['gen', 'MAT', ''])} name", rf"\p para{note}", rf"\s1 head{note}", r"\q", r"\zz odd", "plain line", "", "   ", "\ufeffmark"]))
    return "\ufeff" * rng.randrange(2) + rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", "\n\n"])


def shown(items):
    return sorted(map(tuple, items.select(*SHOWN).collect()), key=lambda r: (r[0], r[6]))


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(11)
    return {f"f{k}": random_file(rng, n) for k, n in enumerate([0, 1, 2, 3, 10, 60, 60, 150])}


@pytest.mark.parametrize("size", [1, 3, 50])
def test_any_number_of_ranges(spark, contents, size):
    files = spark.createDataFrame(list(contents.items()), "file string, content string")
    want = [row for file in sorted(contents) for row in scan(file, contents[file])]
    assert shown(markers.parse(files, size=size, chars=-1)) == want


def test_one_range(spark, contents):
    files = spark.createDataFrame(list(contents.items()), "file string, content string")
    want = [row for file in sorted(contents) for row in scan(file, contents[file])]
    assert shown(markers.parse(files)) == want


def test_a_file_read_in_splits(spark, tmp_path, contents):
    for name, text in contents.items():
        (tmp_path / f"{name}.sfm").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = markers.read_lines(spark, str(tmp_path))
        assert lines.select("file", "range").distinct().count() > 20
        got = [(r[0].rsplit("/", 1)[1].removesuffix(".sfm"), *r[1:]) for r in shown(markers.parse_lines(lines))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [row for file in sorted(contents) for row in scan(file, contents[file])]


def test_no_window_holds_a_file(spark, contents):
    """Windows over lines and items are by range; those by file alone are over one row a range."""
    files = spark.createDataFrame(list(contents.items()), "file string, content string")
    plan = markers.parse_lines(markers._lines(ranges.pieces_of(files, size=5)))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "row_number" in line:
            assert "range#" in line.split("], [")[1]
