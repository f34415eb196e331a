from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.dims import HEADERS
from vellum.sinks import exchange
from vellum.sources import files, markers, tables, word


def _parse(spark, *lines, name="a.usfm"):
    df = spark.createDataFrame([(name, "\n".join(lines))], "file string, content string")
    return markers.parse(df).orderBy("sequence_no").collect()


def test_bom_and_line_ends(spark):
    df = spark.createDataFrame([("a", "﻿\\id MAT Test  name\r\n\\c 1\r\n\\v 1 Text\r\n")], "file string, content string")
    rows = markers.parse(df).orderBy("sequence_no").collect()
    assert [(r.content_type, r.current_text, r.book_code, r.chapter, r.verse) for r in rows] == [("book_id", "Test name", "MAT", None, None), ("chapter", "1", "MAT", 1, None), ("scripture", "Text", "MAT", 1, "1")]
    assert [r.semantic_key for r in rows] == ["MAT|book_id", "MAT|1|chapter", "MAT|1|1|scripture"]
    assert rows[2].protection_level == "protected_scripture" and rows[2].source_locator == "line:3"


def test_notes(spark):
    rows = _parse(spark, r"\id MAT", r"\c 1", r"\v 1 Before \f + \fr 1:1 \ft note\f* more \x + \xo 1:1 \xt Gen 1:1\x* after")
    verse, foot, cross = rows[2:]
    assert verse.current_text == "Before more after"
    assert (foot.content_type, foot.current_text, foot.parent_semantic_key, foot.source_locator) == ("footnote", "+ 1:1 note", verse.semantic_key, "line:3:footnote")
    assert (cross.content_type, cross.marker, cross.warning) == ("cross_reference", "x", None)
    assert foot.match_key == "MAT|1|1|footnote|0" and foot.semantic_key == "MAT|1|1|footnote|f||0"


def test_notes_that_are_not_closed(spark):
    rows = _parse(spark, r"\c 2", r"\v 1 Text \f + \ft note", r"\v 2 Text \x + \xt Gen 1:1")
    assert [r.warning for r in rows if r.warning] == ["unclosed_footnote", "unclosed_cross_reference"]
    assert [r.current_text for r in rows if r.content_type == "scripture"] == ["Text", "Text"]


def test_state_is_carried_forward(spark):
    rows = _parse(spark, "free text", r"\id gen", r"\s One", r"\c 3", r"\s Two", r"\v 1-2 A", r"\s Three", r"\s Four", r"\c x", r"\zz odd", "more")
    assert [(r.content_type, r.chapter, r.verse, r.match_key.rsplit("|", 1)[1]) for r in rows] == [
        ("continuation", None, None, "0"), ("book_id", None, None, "book_id"), ("section_heading", None, None, "0"), ("chapter", 3, None, "chapter"), ("section_heading", 3, None, "0"),
        ("scripture", 3, "1-2", "scripture"), ("section_heading", 3, "1-2", "0"), ("section_heading", 3, "1-2", "1"), ("chapter", 3, None, "chapter"), ("other", 3, None, "0"), ("continuation", 3, None, "0"),
    ]
    assert rows[0].semantic_key.startswith("UNK|0||continuation")
    stats = markers.statistics(markers.parse(spark.createDataFrame([("a", "\\c 2\n\\v 1 a\n\\c 1\n\\v 1 b")], "file string, content string"))).first()
    assert stats.chapters == [1, 2] and stats.verses == 2 and stats.stats == {"chapter": 2, "scripture": 2}


def test_delimited_cells():
    assert tables.read_rows('a,b\r\n"x, ""y""\n z",2\n,\nmid"quo,ted",3', ",") == [["a", "b"], ['x, "y"\n z', "2"], ["midquo,ted", "3"]]
    with pytest.raises(ValueError):
        tables.read_rows('a,"b', ",")


def test_delimited_aliases_and_canonical_form():
    loose = tables.delimited_items("﻿Book,Ch,Vs,Tags,Translation\nMAT,1,2-3,\\v,Hello\nMAT,x,,,\n", ",")
    assert [(i["book_code"], i["chapter"], i["verse"], i["marker"], i["current_text"], i["semantic_key"], i["sequence_no"]) for i in loose] == [("MAT", 1, "2-3", "\\v", "Hello", "ROW|1", 0), ("MAT", None, None, None, "MAT,x,,,", "ROW|2", 1)]
    row = dict.fromkeys(HEADERS, "") | {"matchKey": "m", "chapter": "-1", "currentText": "t", "sequenceNo": "0"}
    (item,) = tables.delimited_items("\t".join(HEADERS) + "\n" + "\t".join(row[h] for h in HEADERS), "\t")
    assert (item["semantic_key"], item["chapter"], item["raw_text"], item["sequence_no"], item["protection_level"]) == ("m", -1, "t", 0, "normal")
    assert tables.delimited_items("", ",") == []


def test_json_forms():
    assert [i["current_text"] for i in tables.json_items('["a", {"text": "b", "chapter": 0}]')] == ["a", "b"]
    (item,) = tables.json_items('{"items": [{"currentText": "x", "chapter": "7", "semanticKey": "k"}]}')
    assert (item["chapter"], item["match_key"], item["source_locator"]) == (7, "k", "record:1")
    assert tables.json_items('{"text": "one"}')[0]["semantic_key"] == "JSON|1"


def test_files_of_all_formats(spark, tmp_path):
    (tmp_path / "a.SFM").write_text("\\id MRK\n\\c 1\n\\v 1 Hi")
    (tmp_path / "b.csv").write_text("text\nrow")
    (tmp_path / "c.tsv").write_text("text\tBook\nrow\tMAT")
    (tmp_path / "d.json").write_text('["s"]')
    (tmp_path / "e.json").write_text("{bad")
    (tmp_path / "f.doc").write_bytes(word.OLE_SIGNATURE + b"rest")
    (tmp_path / "g.xyz").write_text("?")
    rows = files.parse(files.read(spark, str(tmp_path))).collect()
    by = lambda end: [r for r in rows if r.file.endswith(end)]
    assert len(by("a.SFM")) == 3 and by("c.tsv")[0].book_code == "MAT" and by("d.json")[0].current_text == "s"
    assert all(by(x)[0].content_type == "unreadable" and by(x)[0].warning for x in ("e.json", "f.doc", "g.xyz"))
    assert by("b.csv")[0].content_hash and by("a.SFM")[2].logical_key == "MRK|1|1|scripture"
    roles = spark.createDataFrame([("My-Footnotes.csv",), ("xrefs.csv",), ("x.csv",)], "n string").select(files.guess_role(F.col("n"))).collect()
    assert [r[0] for r in roles] == ["footnotes", "other", "other"]


ITEMS = [
    ("k1", "m1", "MAT", 1, "1", "scripture", "v", 1, "en", "source", 'A "quoted", text\nwith 1/16', "\\v 1 A text"),
    ("k1", "m1", "MAT", 1, "1", "scripture", "v", 2, "ta", "target", "தமிழ் 1/16 & <x>", "\\v 1 தமிழ்"),
    ("k2", "m2", "MAT", 1, None, "section_heading", "s", 3, "en", "source", "Head", None),
]
COLUMNS = "semantic_key string, match_key string, book_code string, chapter int, verse string, content_type string, marker string, sequence_no int, language_code string, language_role string, current_text string, raw_text string"


@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_delimited_round_trip(spark, delimiter):
    items = spark.createDataFrame(ITEMS, COLUMNS)
    text = "\n".join([delimiter.join(HEADERS)] + [r.line for r in exchange.delimited_lines(items, delimiter).collect()])
    back = tables.delimited_items(text, delimiter)
    assert [(i["semantic_key"], i["chapter"], i["current_text"], i["language_role"]) for i in back] == [(r[0], r[3], r[10], r[9]) for r in ITEMS]


def test_json_and_marker_round_trip(spark):
    items = spark.createDataFrame(ITEMS, COLUMNS)
    text = exchange.json_envelope(items, "2024-01-01T00:00:00Z").first().json
    assert [i["current_text"] for i in tables.json_items(text)] == [r[10] for r in ITEMS]
    book = spark.createDataFrame([("a", "\\id MAT\n\\c 1\n\\v 1 Text \\f + note\\f* x\n\\s Head")], "file string, content string")
    lines = exchange.marker_lines(markers.parse(book)).orderBy("sequence_no").collect()
    assert [r.line for r in lines] == [r"\id MAT", r"\c 1", r"\v 1 Text \f + note\f* x", r"\s Head"]
    assert [r.line for r in exchange.marker_lines(items.filter("semantic_key = 'k2'").withColumn("source_locator", F.lit(None).cast("string"))).collect()] == [r"\s Head"]


def test_docx_round_trip(spark):
    content = exchange.docx_bytes(spark.createDataFrame(ITEMS, COLUMNS))
    back = word.docx_items(content, "x/MAT-notes.docx")
    assert [(i["semantic_key"], i["language_role"], i["current_text"]) for i in back] == [("k1", "source", ITEMS[0][10]), ("k1", "target", ITEMS[1][10]), ("k2", "source", "Head"), ("k2", "target", "")]
    df = spark.createDataFrame([("x/MAT-notes.docx", content), ("y.docx", b"no zip")], "file string, content binary")
    rows = word.parse_docx(df).collect()
    assert len(rows) == 5 and {r.book_code for r in rows if r.warning is None} == {"MAT"}


def test_docx_without_a_table():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>JON</w:t></w:p><w:p><w:t>A &amp;quot; b</w:t><w:tab/><w:t>c</w:t></w:p><w:p></w:p>")
    items = word.docx_items(out.getvalue(), "n.docx")
    assert [(i["book_code"], i["current_text"], i["warning"]) for i in items] == [("JON", "JON", "unstructured_docx"), ("JON", 'A " b\tc', "unstructured_docx")]


def test_row_types():
    cases = {(r"\ef", ""): "study_note", (r"\p", r"\xt"): "cross_reference", (r"\ft", ""): "footnote", (r"\s1", ""): "section_heading", (r"\c", ""): "chapter_marker", (r"\v", ""): "scripture_fragment", ("", r"\fig"): "figure", ("", ""): "docx_record"}
    assert {k: word.row_type(*k) for k in cases} == cases


def test_absent_rows(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [r.k for r in exchange.append_absent(new, spark.createDataFrame([(2,)], "k int"), "k").collect()] == [1]


def test_one_file_formats_are_bounded(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame(ITEMS, COLUMNS)
    monkeypatch.setattr(exchange._bounded, "__defaults__", (2,))
    for write in (lambda: exchange.json_envelope(items, "now"), lambda: exchange.docx_bytes(items)):
        with pytest.raises(ValueError, match="more than 2 items"):
            write()
    book = spark.createDataFrame([("a", "\\id MAT\n\\c 1\n\\v 1 Text\n\\v 2 More")], "file string, content string").unionAll(spark.createDataFrame([("b", "\\id JON\n\\c 4")], "file string, content string"))
    exchange.write_markers(markers.parse(book), str(tmp_path / "out"))
    lines = {p.parent.name: p.read_text().split() for p in (tmp_path / "out").rglob("*.txt")}
    assert lines == {"book_code=MAT": ["\\id", "MAT", "\\c", "1", "\\v", "1", "Text", "\\v", "2", "More"], "book_code=JON": ["\\id", "JON", "\\c", "4"]}


def test_nested_tables_and_broken_markup():
    def document(xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", xml)
        return out.getvalue()

    cell = lambda t: f"<w:tc><w:p w:x='1'/><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = "<w:tr>" + cell("Tags") + cell("English") + "</w:tr><w:tr>" + cell("\\\\s") + cell("a<w:br/>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t> in") .replace("</w:tc>", "</w:tc></w:tr></w:tbl><w:p/></w:tc>", 1) + "</w:tr>"
    items = word.docx_items(document(f"<?xml version='1.0'?><w:document><w:tbl>{rows}</w:tbl></w:document>"), "MAT.docx")
    assert [(i["language_role"], i["current_text"], i["content_type"]) for i in items] == [("source", "a\nb in", "section_heading")]
    with pytest.raises(ValueError, match="no readable"):
        word.docx_items(document("<w:p><w:t>x</w:p>"), "x.docx")
