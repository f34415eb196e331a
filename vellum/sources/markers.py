"""Line-marker text (USFM, SFM) to canonical items, by windows over pieces of a file instead of a scanner's state.

A file is a sequence of ranges of lines.  Book, chapter and verse are carried forward by windows over a
range; ordinals and sequence numbers are row numbers in it.  A file of several ranges is finished by
prefix scans over one summary row a range: the last book and chapter, the last verse since the last
chapter mark, and the numbers of lines, of items, and of items in each scope.  So no window holds more than
a range of lines, or one row a range, and the items do not depend on where a file is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import dims
from vellum.functions import text as T
from vellum.sources import ranges
from vellum.sources.ranges import RANGE

def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, range, nth, line of files of any size."""
    return _lines(ranges.read_pieces(spark, path))


def _lines(pieces: DataFrame) -> DataFrame:
    return pieces.select(*RANGE, "nth", F.regexp_replace("piece", "\r$", "").alias("line"))


def _notes(body: Column, marker: str) -> Column:
    """Notes that start with the marker, closed or running to the end of the line."""
    return F.regexp_extract_all(body, F.lit(rf"\\{marker}(?=\s)(?:[\s\S]*?\\{marker}\*|[\s\S]*$)"), F.lit(0))


def parse(files: DataFrame, size: int = ranges.RANGE_PIECES, chars: int = ranges.RANGE_CHARS) -> DataFrame:
    """Canonical items of files (file, content); unclosed notes carry a warning.

    Files of more than `chars` characters are cut into ranges of `size` lines; the items are the same.
    """
    large = F.length("content") > chars
    one = _lines(ranges.pieces_of(files.filter(~large), size=size)).withColumns({"nth": F.col("range") * size + F.col("nth"), "range": F.lit(0).cast("long")})
    return _items(one, False).union(_items(_lines(ranges.pieces_of(files.filter(large), size=size)), True))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Canonical items of lines (file, range, nth, line), as read_lines gives them; nth counts from 0 in each range."""
    return _items(lines, True)


def _with_starts(lines: DataFrame, own: dict[str, Column]) -> DataFrame:
    """lines with what earlier ranges tell: _book, _chapter, _told (whether a verse or chapter mark has told a verse), _lines."""
    marks = lines.select(*RANGE, "nth", "marker", *[v.alias(k) for k, v in own.items()])
    at = lambda mark: F.max(F.when(F.col("marker") == mark, F.col("nth")))
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("nth")))
    effects = marks.groupBy(*RANGE).agg(F.count("*").alias("lines"), last("own_book").alias("book"), last("own_chapter").alias("chapter"), at("c").alias("c"), at("v").alias("v"), last("own_verse").alias("verse"))
    # the verse behind a range: null inside the struct is "none", a null struct is "as before"
    verse = F.when(F.coalesce("c", "v").isNotNull(), F.struct(F.when(F.coalesce("v", F.lit(-1)) > F.coalesce("c", F.lit(-1)), F.col("verse")).alias("verse")))
    starts = effects.select(*RANGE, ranges.earlier("book").alias("_book"), ranges.earlier("chapter").alias("_chapter"), ranges.earlier(verse).alias("_verse"), ranges.summed_before("lines").alias("_lines"))
    return lines.join(starts, RANGE)


def _items(lines: DataFrame, several: bool) -> DataFrame:
    """Items of lines; several: files may have more than one range."""
    lines = lines.withColumn("trimmed", T.trim(F.col("line")))
    marker = r"(?s)^\\([^\s]+)(?:\s+(.*))?$"
    lines = lines.withColumn("full", F.regexp_extract("trimmed", marker, 1)).withColumn("rest", F.regexp_extract("trimmed", marker, 2))
    lines = lines.withColumn("marker", F.nullif(F.regexp_replace("full", r"\*$", ""), F.lit("")))
    m, rest = F.col("marker"), F.col("rest")
    own = {
        "own_book": F.when(m == "id", F.nullif(F.upper(F.regexp_extract("rest", r"^\s*(\S+)", 1)), F.lit(""))),
        "own_chapter": F.when(m == "c", F.regexp_extract("rest", r"^\s*(-?[0-9]+)", 1).try_cast("int")),
        "own_verse": F.when(m == "v", F.regexp_extract("rest", r"^(\S+)", 1)),
    }
    if several:
        lines = _with_starts(lines, own)
    else:
        lines = lines.withColumns({"_book": F.lit(None).cast("string"), "_chapter": F.lit(None).cast("int"), "_verse": F.lit(None).cast("struct<verse: string>"), "_lines": F.lit(0).cast("long")})
    lines = lines.filter("trimmed <> ''").withColumn("at", F.col("_lines") + F.col("nth"))
    run = Window.partitionBy(*RANGE).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    told = F.when(m == "c", F.struct(F.lit(None).cast("string").alias("verse"))).when(m == "v", F.struct(own["own_verse"].alias("verse")))
    lines = lines.withColumns(
        {
            "book_code": F.coalesce(F.last(own["own_book"], ignorenulls=True).over(run), "_book"),
            "chapter": F.coalesce(F.last(own["own_chapter"], ignorenulls=True).over(run), "_chapter"),
            "verse": F.coalesce(F.last(told, ignorenulls=True).over(run), "_verse")["verse"],
        }
    )
    lines = lines.withColumn("verse", F.when(~F.coalesce(m.isin("id", "c"), F.lit(False)), F.col("verse")))
    body = F.when(m == "v", F.regexp_extract("rest", r"(?s)^\S+\s*(.*)$", 1)).when(m.isin("id", "c") | m.isNull(), F.lit("")).otherwise(rest)
    lines = lines.join(F.broadcast(dims.marker_types(lines.sparkSession)), "marker", "left").withColumn("body", body)  # 66 rows
    kind = F.when(m.isNull(), "continuation").otherwise(F.coalesce("content_type", F.lit("other")))
    # the words after the book code, joined by single spaces
    tail = F.array_join(F.slice(F.filter(F.split(rest, r"\s+"), lambda x: x != ""), 2, 1_000_000), " ")
    visible = F.when(m.isNull(), F.col("line")).when(m == "id", tail).when(m == "c", rest).otherwise(T.strip_notes(F.col("body")))
    entry = lambda k, order, mark, raw, text, open_: F.struct(k.alias("content_type"), F.lit(order).alias("part"), mark.alias("marker"), raw.alias("raw_text"), text.alias("current_text"), open_.alias("unclosed"))
    note = lambda k, order, mark: F.transform(_notes(F.col("body"), mark), lambda x: entry(F.lit(k), order, F.lit(mark), x, F.lit(None).cast("string"), ~x.endswith(f"\\{mark}*")))
    parts = F.concat(F.array(entry(kind, 0, m, F.col("line"), visible, F.lit(False))), note("footnote", 1, "f"), note("cross_reference", 2, "x"))
    items = lines.select(*RANGE, "at", "book_code", "chapter", "verse", F.posexplode(parts).alias("pos", "item")).select(*RANGE, "at", "pos", "book_code", "chapter", "verse", "item.*")
    items = items.withColumn("current_text", F.when(F.col("part") > 0, T.strip_markers(F.col("raw_text"))).otherwise(F.col("current_text")))
    return _identified(items, several)


def _numbered(items: DataFrame, several: bool) -> DataFrame:
    """items with nth_item, nth_narrow and nth_scope: their number in the file and in two scopes of it, from 0."""
    nth = lambda *scope: F.row_number().over(Window.partitionBy(*RANGE, *scope).orderBy("at", "pos")) - 1
    items = items.withColumns({"nth_item": nth().cast("long"), "nth_narrow": nth("_narrow").cast("long"), "nth_scope": nth("_scope").cast("long")})
    if not several:
        return items
    each = items.groupBy(*RANGE, "_scope", "_narrow").agg(F.count("*").alias("n"))
    whole = each.groupBy(*RANGE).agg(F.sum("n").alias("n")).select(*RANGE, ranges.summed_before("n").alias("b_item"))
    wide = each.groupBy(*RANGE, "_scope").agg(F.sum("n").alias("n")).select(*RANGE, "_scope", ranges.summed_before("n", "_scope").alias("b_scope"))
    narrow = each.select(*RANGE, "_narrow", ranges.summed_before("n", "_narrow").alias("b_narrow"))
    # most scopes lie in one range and need nothing from before
    items = items.join(whole, RANGE).join(wide.filter("b_scope > 0"), [*RANGE, "_scope"], "left").join(narrow.filter("b_narrow > 0"), [*RANGE, "_narrow"], "left")
    return items.withColumns({f"nth_{k}": F.col(f"nth_{k}") + F.coalesce(f"b_{k}", F.lit(0)) for k in ("item", "narrow", "scope")})


def _identified(items: DataFrame, several: bool) -> DataFrame:
    book, chapter, verse = F.coalesce("book_code", F.lit("UNK")), F.coalesce("chapter", F.lit(0)), F.coalesce("verse", F.lit(""))
    kind = F.col("content_type")
    scope = F.concat_ws("|", book, chapter, verse, kind)
    narrow = F.concat_ws("|", scope, F.coalesce("marker", F.lit("")), F.lit(""))
    items = _numbered(items.withColumns({"_scope": scope, "_narrow": narrow}), several)
    special = F.when(kind == "scripture", scope).when(kind == "chapter", F.concat_ws("|", book, chapter, F.lit("chapter"))).when(kind == "book_id", F.concat_ws("|", book, F.lit("book_id")))
    items = items.withColumns(
        {
            "sequence_no": F.col("nth_item").cast("int"),
            "semantic_key": F.coalesce(special, F.concat_ws("|", "_narrow", F.col("nth_narrow").cast("string"))),
            "match_key": F.coalesce(special, F.concat_ws("|", "_scope", F.col("nth_scope").cast("string"))),
            "normalized_text": T.normalize(F.col("current_text")),
        }
    )
    parent = F.first("semantic_key").over(Window.partitionBy(*RANGE, "at").orderBy("pos"))
    line = F.concat(F.lit("line:"), F.col("at") + 1)
    return items.select(
        "file", "book_code", "chapter", "verse", "content_type", "marker", F.lit(None).cast("string").alias("category"), "sequence_no", "semantic_key", "match_key",
        F.when(F.col("part") > 0, parent).alias("parent_semantic_key"), "raw_text", "current_text", "normalized_text", F.sha2("normalized_text", 256).alias("content_hash"),
        F.when(kind == "scripture", "protected_scripture").otherwise("normal").alias("protection_level"),
        F.concat(line, F.element_at(F.array(F.lit(""), F.lit(":footnote"), F.lit(":crossref")), F.col("part") + 1)).alias("source_locator"),
        F.when(F.col("unclosed"), F.concat(F.lit("unclosed_"), "content_type")).alias("warning"),
    )


def statistics(items: DataFrame) -> DataFrame:
    """For each file: items by type, chapters in order, number of verses."""
    types = items.groupBy("file", "content_type").count().groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "count")))).alias("stats"))
    rest = items.groupBy("file").agg(F.array_sort(F.collect_set("chapter")).alias("chapters"), F.count_if(F.col("content_type") == "scripture").alias("verses"))
    return types.join(rest, "file")
