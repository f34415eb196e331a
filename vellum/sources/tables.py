"""CSV and TSV files, exact to the cell, and JSON record files.

A quote toggles quoting anywhere in a cell, which Spark's own CSV reader does not do.  A small file is read
in one go.  A large one is a sequence of lines over many tasks: the parity of the quotes before a line, a
prefix sum over the line's range and one summary row a range, tells whether the line begins outside quotes.
Lines between two such places are one chunk, whose rows are exact whatever the ranges; row numbers are a
second prefix sum, and the header is row 0.  Rows end at line feeds, carriage returns or both; a file
without a line feed is one line, and an open quote makes the whole file unreadable.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.dims import HEADERS
from vellum.sources import ranges
from vellum.sources.items import SCHEMA, finish
from vellum.sources.ranges import RANGE

_TOKEN = re.compile(r'"|\r\n|\r|\n|[^"\r\n]+')
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_INTEGER = re.compile(r"-?[0-9]+\Z")
_SPACES = re.compile(r"[\s\ufeff]+")
OPEN_QUOTE = "a quoted field is not closed"


def read_rows(text: str, delimiter: str) -> list[list[str]]:
    """Cells of delimited text; rows whose cells are all empty are left out.  ValueError for an open quote."""
    rows, row, cell, quoted = [], [], [], False
    tokens = _TOKEN.findall(text)
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t == '"':
            if quoted and i + 1 < len(tokens) and tokens[i + 1] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif quoted:
            cell.append(t)
        elif t[0] in "\r\n":
            row.append("".join(cell))
            rows.append(row)
            row, cell = [], []
        else:
            first, *more = t.split(delimiter)
            cell.append(first)
            for x in more:
                row.append("".join(cell))
                cell = [x]
        i += 1
    if quoted:
        raise ValueError(OPEN_QUOTE)
    rows.append([*row, "".join(cell)])
    return [r for r in rows if any(r)]


def _number(x) -> int | None:
    """A number as scripts read it: 0 and what is no number give None."""
    try:
        return int(float(x)) or None
    except (TypeError, ValueError, OverflowError):
        return None


def _first(record: dict, names: tuple[str, ...], empty_counts: bool) -> str | None:
    for n in names:
        v = record.get(n)
        if v is not None and (empty_counts or v != ""):
            return v
    return None


def titles(cells: list[str]) -> list[str]:
    return [_SPACES.sub(" ", re.sub("[\u200b\u200c\u200d\ufeff]", "", h)).strip() for h in cells]


def delimited_item(header: list[str], cells: list[str], nth: int, delimiter: str) -> dict:
    """The canonical item of one row: by the 18 fixed headers if all are there, else by loose aliases."""
    canonical = set(HEADERS) <= set(header)
    record = {h or f"column_{i + 1}": cells[i] if i < len(cells) else "" for i, h in enumerate(header)}
    get = lambda *names: _first(record, names, False)
    whole = delimiter.join(cells)
    if canonical:
        text_, raw = record["currentText"], record["rawText"] or record["currentText"]
        key = get("semanticKey", "matchKey") or f"ROW|{nth + 1}"
    else:
        text_ = get("currentText", "current_text", "Translation", "English", "text")
        text_ = whole if text_ is None else text_
        raw = get("rawText", "raw_text") or whole
        key = get("semanticKey", "semantic_key", "logicalKey", "logical_key") or f"ROW|{nth + 1}"
    both = lambda camel, snake, *more: get(camel) if canonical else get(camel, snake, *more)
    chapter = both("chapter", "chapter", "Ch") or ""
    return {
        "book_code": both("bookCode", "book_code", "Book", "book", "BOOK"), "chapter": int(chapter) if _INTEGER.match(chapter) else None, "verse": both("verse", "verse", "Vs"),
        "content_type": both("contentType", "content_type") or "table_row", "marker": both("marker", "marker", "Tags"), "category": both("category", "category", "Sub-Tags"),
        "sequence_no": _number(both("sequenceNo", "sequence_no")) or nth, "semantic_key": key, "match_key": both("matchKey", "match_key") or key,
        "parent_semantic_key": both("parentSemanticKey", "parent_semantic_key"), "raw_text": raw, "current_text": text_,
        "protection_level": both("protectionLevel", "protection_level") or "normal", "source_locator": both("sourceLocator", "source_locator") or f"row:{nth + 2}",
        "language_role": both("languageRole", "language_role"), "language_code": both("languageCode", "language_code"), "resource_role": get("resourceRole") if canonical else None,
    }


def delimited_items(text: str, delimiter: str) -> list[dict]:
    """Canonical items of one file."""
    header, *rows = read_rows(text.removeprefix("\ufeff"), delimiter) or [[]]
    return [delimited_item(titles(header), cells, nth, delimiter) for nth, cells in enumerate(rows)]


def json_record(record) -> dict:
    """The canonical item of one record; what depends on its place in the file is left out (see _placed)."""
    if not isinstance(record, dict):
        record = {"text": record, "rawText": record} if isinstance(record, str) else {}
    get = lambda *names: _first(record, names, True)
    text_of = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    raw = get("rawText", "raw_text")
    return {
        "book_code": text_of(get("bookCode", "book_code", "book")), "chapter": _number(get("chapter")), "verse": text_of(get("verse")),
        "content_type": text_of(get("contentType", "content_type", "type")) or "json_record", "marker": text_of(get("marker")), "category": text_of(get("category")),
        "sequence_no": _number(get("sequenceNo", "sequence_no")), "semantic_key": text_of(get("semanticKey", "semantic_key", "logicalKey", "logical_key")) or None, "match_key": text_of(get("matchKey", "match_key")) or None,
        "parent_semantic_key": text_of(get("parentSemanticKey", "parent_semantic_key")), "raw_text": json.dumps(record, ensure_ascii=False, separators=(",", ":")) if raw is None else text_of(raw),
        "current_text": text_of(get("currentText", "current_text", "text")) or "", "protection_level": text_of(get("protectionLevel", "protection_level")) or "normal", "source_locator": text_of(get("sourceLocator", "source_locator")) or None,
        "language_role": text_of(get("languageRole", "language_role")), "language_code": text_of(get("languageCode", "language_code")), "resource_role": text_of(get("resourceRole", "resource_role")),
    }


def _placed(items: DataFrame) -> DataFrame:
    """items with `number` (from 0): the defaults that follow from it, as in json_items."""
    nth = (F.col("number") + 1).cast("string")
    key = F.coalesce("semantic_key", F.concat(F.lit("JSON|"), nth))
    return items.withColumns({"sequence_no": F.coalesce("sequence_no", F.col("number").cast("int")), "semantic_key": key, "match_key": F.coalesce("match_key", key), "source_locator": F.coalesce("source_locator", F.concat(F.lit("record:"), nth))})


def json_records(text: str) -> list:
    """The records of one file: an array, an object with `items`, or one object."""
    root = json.loads(text.removeprefix("\ufeff"))
    return root if isinstance(root, list) else root["items"] if isinstance(root, dict) and isinstance(root.get("items"), list) else [root]


def json_items(text: str) -> list[dict]:
    """Canonical items of one file."""
    items = []
    for nth, record in enumerate(json_records(text)):
        item = json_record(record)
        key = item["semantic_key"] or f"JSON|{nth + 1}"
        items.append(item | {"sequence_no": item["sequence_no"] or nth, "semantic_key": key, "match_key": item["match_key"] or key, "source_locator": item["source_locator"] or f"record:{nth + 1}"})
    return items


_DECODER = json.JSONDecoder()
_BLANK = re.compile(r"[ \t\n\r]*")


def _value(text: str, at: int) -> tuple[object, int]:
    """The value at a place behind blanks, and where the next thing begins."""
    value, end = _DECODER.raw_decode(text, _BLANK.match(text, at).end())
    return value, _BLANK.match(text, end).end()


def _behind_head(text: str) -> str:
    """What follows the `[` of a root object's items; ValueError where a member before them is not complete."""
    at = 1
    while True:
        key, at = _value(text, at)
        start = _BLANK.match(text, at + 1).end()
        if not isinstance(key, str) or text[at : at + 1] != ":":
            raise ValueError("no member")
        if key == "items" and text[start : start + 1] == "[":
            return text[start + 1 :]
        _, at = _value(text, start)
        if text[at : at + 1] != ",":
            raise ValueError("no items")
        at += 1


def _before_tail(text: str) -> str:
    """What stands before the `]` of a root object's items; ValueError where the rest holds items again."""
    at = _BLANK.match(text).end()
    while text[at : at + 1] != "]":
        _, at = _value(text, at + (text[at : at + 1] == ","))
    if "items" in json.loads('{"":0' + text[at + 1 :]):
        raise ValueError("items twice")
    return text[:at]


def chunk_records(text: str, root: str, first: bool, last: bool) -> list:
    """The records of a stretch of a large file between two of its records; ValueError where that is none."""
    text = text.strip(" \t\n\r")
    if first:
        text = text[1:] if root == "[" else _behind_head(text)
    if last:
        if root == "[" and not text.endswith("]"):
            raise ValueError("the array does not end")
        text = text[:-1] if root == "[" else _before_tail(text)
    text = text.strip(" \t\n\r")
    if not first and text:
        if text[0] != ",":
            raise ValueError("no comma")
        text = text[1:].strip(" \t\n\r")
        if not text:
            raise ValueError("no value")
    if not text and not last:
        raise ValueError("no value")
    return json.loads(f"[{text}]")


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object).astype({"chapter": "Int32", "sequence_no": "Int32"})


def _parsed(files: DataFrame, read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    rows += [x | {"file": file} for x in read(bytes(content))]
                except (ValueError, KeyError) as error:  # one bad file must not end the job: it is reported as a row
                    rows.append({"file": file, "content_type": "unreadable", "warning": str(error)[:500]})
            yield _frame(rows)

    return finish(files.select("file", "content").mapInPandas(run, SCHEMA))


def parse_delimited(files: DataFrame, delimiter: str = ",", size: int = ranges.RANGE_PIECES, chars: int = ranges.RANGE_CHARS) -> DataFrame:
    """Items of files (file, content as bytes); those of more than `chars` bytes are read in ranges of `size` lines."""
    large = F.length("content") > chars
    small = _parsed(files.filter(~large), lambda b: delimited_items(b.decode("utf-8", "replace"), delimiter))
    return small.union(parse_delimited_lines(ranges.pieces_of(files.filter(large).select("file", ranges.text_of("content")), size=size), delimiter))


def _chunks(lines: DataFrame) -> DataFrame:
    """file, range, nth, text of the stretches of lines that begin and end outside quotes."""
    lines = lines.withColumn("q", F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit(""))))
    fresh = F.col("before") % 2 == 0
    lines = ranges.with_sum_before(lines, "q", "before").withColumns({"fresh": fresh, "alone": fresh & (F.col("q") % 2 == 0)})
    return ranges.stretches(lines, "\n")


def parse_delimited_lines(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Items of files as lines (file, range, nth, piece), cut at line feeds."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, r, n, k, cells) for f, r, n, text in zip(pdf["file"], pdf["range"], pdf["nth"], pdf["text"], strict=True) for k, cells in enumerate(read_rows(text, delimiter))]
            yield pd.DataFrame(found, columns=["file", "range", "nth", "k", "cells"])

    def items_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [delimited_item(titles(list(header)), list(cells), int(n) - 1, delimiter) | {"file": f} for f, header, cells, n in zip(pdf["file"], pdf["header"], pdf["cells"], pdf["number"], strict=True)]
            yield _frame(found)

    odd = lines.groupBy("file").agg(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))).alias("n")).filter("n % 2 = 1").select("file")
    chunks = _chunks(lines.join(odd, "file", "left_anti"))
    rows = ranges.numbered(chunks.mapInPandas(rows_of, "file string, range long, nth long, k long, cells array<string>"), "nth", "k")
    headers = rows.filter("number = 0").select("file", F.col("cells").alias("header"))
    items = rows.filter("number > 0").join(headers, "file").select("file", "header", "cells", "number").mapInPandas(items_of, SCHEMA)
    unread = odd.select("file", *[F.lit({"content_type": "unreadable", "warning": OPEN_QUOTE}.get(c)).cast(kind).alias(c) for c, kind in (x.split() for x in SCHEMA.split(", ")) if c != "file"])
    return finish(items.union(unread))


def parse_json(files: DataFrame, size: int = ranges.RANGE_PIECES, chars: int = ranges.RANGE_CHARS) -> DataFrame:
    """Items of files (file, content as bytes); those of more than `chars` bytes are read in ranges of `size` pieces."""
    large = F.length("content") > chars
    return _json_files(files.filter(~large)).union(parse_json_pieces(ranges.pieces_of(files.filter(large).select("file", ranges.text_of("content")), "}", size)))


def _json_files(files: DataFrame) -> DataFrame:
    """Items of files (file, content as bytes), each read in one go."""
    return _parsed(files, lambda b: json_items(b.decode("utf-8", "replace")))


def _json_chunks(pieces: DataFrame) -> DataFrame:
    """file, range, nth, text, root, first, last of the stretches between the records of an array, or of an object's items.

    pieces are cut at `}`.  The parity of the quotes that no backslash escapes tells whether a piece begins
    inside a string; with it, brackets outside strings add up to the depth.  A record ends where a `}` brings
    the depth back to that of the array (1), or of an array in an object (2).
    """
    place = F.struct("range", "nth")
    # whether a brace that ends the file has been left out
    ended = F.sum("octets") == F.max("file_size") if "octets" in pieces.columns else F.lit(False)
    files = pieces.groupBy("file").agg(ended.alias("ended"), F.substring(F.ltrim(F.min_by(F.regexp_replace("piece", "[\t\n\r]", " "), place)), 1, 1).alias("root"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    pieces = pieces.join(files, "file").withColumns({"first": place == F.col("lo"), "last": place == F.col("hi")}).drop("lo", "hi", "octets", "file_size")
    pieces = pieces.withColumn("parts", F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')).withColumn("q", F.size("parts") - 1)
    pieces = ranges.with_sum_before(pieces, "q", "quotes")
    inside = F.col("quotes") % 2
    plain = F.array_join(F.filter("parts", lambda x, i: (i + inside) % 2 == 0), "")
    opened = F.length(F.regexp_replace(plain, r"[^{\[]", "")) - F.length(F.regexp_replace(plain, r"[^}\]]", ""))
    ends = (F.col("quotes") + F.col("q")) % 2 == 0  # outside strings
    pieces = pieces.withColumns({"inside": inside == 1, "closes": ~F.col("last") & ends, "opened": opened.cast("long")})
    pieces = pieces.withColumn("change", F.col("opened") - F.col("closes").cast("long")).drop("parts", "q", "quotes")
    pieces = ranges.with_sum_before(pieces, "change", "depth")
    level = F.when(F.col("root") == "[", 1).when(F.col("root") == "{", 2).otherwise(-1)
    behind = F.col("depth") + F.col("change")
    whole = F.when(~F.col("last") | F.col("ended"), F.concat("piece", F.lit("}"))).otherwise(F.col("piece"))
    fresh = F.col("first") | (~F.col("inside") & (F.col("depth") == level))
    pieces = pieces.withColumns({"piece": whole, "fresh": fresh, "alone": fresh & F.col("closes") & (behind == level)})
    found = ranges.stretches(pieces, "").join(files.drop("ended"), "file")
    # the last stretch is the one from the last fresh piece on, unless a record ends the file
    tail = pieces.filter("fresh").groupBy("file").agg(F.max(place).alias("tail"))
    return found.join(tail, "file").select("file", "range", "nth", "text", "root", (place == F.col("lo")).alias("first"), (place == F.col("tail")).alias("last"))


def parse_json_pieces(pieces: DataFrame) -> DataFrame:
    """Items of files as pieces (file, range, nth, piece), cut at `}`.

    Arrays, and objects whose `items` come before any other member with an object inside, are read record by
    record over many tasks; any other file is one value, and is read in one go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, places = [], []
            for file, at, nth, text, root, first, last in zip(*[pdf[c] for c in ("file", "range", "nth", "text", "root", "first", "last")], strict=True):
                try:
                    found = [json_record(x) | {"file": file} for x in chunk_records(text, root, first, last)] if root in ("[", "{") else None
                except (ValueError, IndexError):
                    found = None
                found = [{"file": file, "warning": "whole"}] if found is None else found
                rows += found
                places += [(at, nth, k) for k in range(len(found))]
            yield _frame(rows).assign(**{c: [p[i] for p in places] for i, c in enumerate(("range", "nth", "k"))})

    items = _json_chunks(pieces).mapInPandas(run, f"{SCHEMA}, range long, nth long, k long")
    one = items.filter("warning IS NOT NULL").select("file").distinct()
    regular = _placed(ranges.numbered(items.join(one, "file", "left_anti"), "nth", "k"))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    chunks = _json_chunks(pieces).join(one, "file").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("range", "nth", "text"))).alias("chunks"))
    whole = chunks.select("file", F.encode(F.array_join(F.transform("chunks", lambda x: x["text"]), ""), "utf-8").alias("content"))
    return finish(regular.select(*columns)).union(_json_files(whole))
