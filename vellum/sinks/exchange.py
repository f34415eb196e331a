"""Canonical export: projection, CSV/TSV, JSON, line-marker text, bilingual Word table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.dims import EXCHANGE_VERSION, HEADERS
from vellum.functions import text as T
from vellum.sinks import archive

_SNAKE = {h: "".join("_" + c.lower() if c.isupper() else c for c in h) for h in HEADERS}
_DEFAULT = {"sequenceNo": "0", "protectionLevel": "normal", "reviewStatus": "unreviewed"}


def canonical(items: DataFrame, *more: Column) -> DataFrame:
    """The 18 exchange columns, after `more`; missing columns and nulls take their defaults."""

    def value(header: str) -> Column:
        names = [_SNAKE[header]] + (["semantic_key"] if header == "matchKey" else [])
        found = [F.col(n).cast("string") for n in names if n in items.columns]
        return F.coalesce(*found, F.lit(_DEFAULT.get(header, ""))).alias(header)

    return items.select(*more, *map(value, HEADERS))


def export_rows(items: DataFrame, resources: DataFrame | None = None, book_code: str | None = None, language_code: str | None = None, resource_role: str | None = None) -> DataFrame:
    """Active items in book, chapter and sequence order, each filter only if given.

    resources (resource_id, resource_role, title) takes the place of a role in the items.
    """
    rows = items.filter("canonical_state = 'active'") if "canonical_state" in items.columns else items
    for name, value in (("book_code", book_code), ("language_code", language_code)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    if resources is not None:
        named = resources.select("resource_id", "resource_role", F.col("title").alias("resource_title"))
        rows = rows.drop("resource_role").join(named, "resource_id", "left")
    rows = rows if resource_role is None else rows.filter(F.col("resource_role") == resource_role)
    return rows.orderBy(F.asc_nulls_first("book_code"), F.asc_nulls_first("chapter"), "sequence_no")


def delimited_lines(items: DataFrame, delimiter: str = ",") -> DataFrame:
    """line of each item; a cell is quoted only where it has to be."""
    special = '["\r\n' + ("\t" if delimiter == "\t" else delimiter) + "]"
    cell = lambda c: F.when(F.col(c).rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return canonical(items).select(F.concat_ws(delimiter, *map(cell, HEADERS)).alias("line"))


def write_delimited(items: DataFrame, path: str, delimiter: str = ",") -> None:
    """A folder of part files with header, written in parallel."""
    canonical(items).write.csv(path, header=True, sep=delimiter, quote='"', escape='"', emptyValue="")


def write_json_lines(items: DataFrame, path: str) -> None:
    canonical(items).withColumn("sequenceNo", F.col("sequenceNo").cast("int")).write.json(path)


def json_pieces(items: DataFrame, exported_at: str) -> DataFrame:
    """no, text: a JSON export of any size; the texts in order of no are the file, an item a piece."""
    rows = canonical(items).withColumn("sequenceNo", F.col("sequenceNo").cast("int"))
    placed = numbered(rows.select("sequenceNo", F.to_json(F.struct(*HEADERS)).alias("item")), "sequenceNo", "item")
    each = placed.select(F.col("no").cast("long").alias("no"), F.concat(F.when(F.col("no") > 1, ",").otherwise(""), "item").alias("text"))
    said = lambda x: F.to_json(F.struct(F.lit(x).alias("x"))).substr(6, 1_000_000)  # noqa: E731  the value and the closing brace
    head = F.concat(F.lit('{"schemaVersion":'), F.regexp_replace(said(EXCHANGE_VERSION), r"\}$", ""), F.lit(',"exportedAt":'), F.regexp_replace(said(exported_at), r"\}$", ""), F.lit(',"items":['))
    ends = items.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("no"), head.alias("text")), F.struct(F.lit(2**62).alias("no"), F.lit("]}").alias("text")))).alias("e")).select("e.*")
    return each.union(ends)


#: Items that a format of one file may hold.
ONE_FILE = 200_000


def _bounded(items: DataFrame, most: int = ONE_FILE) -> DataFrame:
    """items, if there are not more than one file may hold; else ValueError.  At most `most` + 1 rows are looked at."""
    if items.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} items do not go into one file: export by book or resource")
    return items


def json_envelope(items: DataFrame, exported_at: str) -> DataFrame:
    """One row with the JSON text of a bounded export (a book, a page); large ones go to write_json_lines."""
    rows = canonical(_bounded(items)).withColumn("sequenceNo", F.col("sequenceNo").cast("int"))
    all_ = F.array_sort(F.collect_list(F.struct("sequenceNo", F.struct(*HEADERS).alias("item"))))
    return rows.agg(F.to_json(F.struct(F.lit(EXCHANGE_VERSION).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt"), F.transform(all_, lambda x: x["item"]).alias("items"))).alias("json"))


def marker_lines(items: DataFrame) -> DataFrame:
    """sequence_no, line of line-marker text; notes that their parent line holds are left out."""
    rows = items.filter(~F.coalesce(F.col("source_locator").rlike(":footnote$|:crossref$"), F.lit(False)))
    raw, text = F.coalesce("raw_text", F.lit("")), F.coalesce("current_text", F.lit(""))
    marker = F.regexp_replace(F.coalesce("marker", F.lit("")), r"^\\", "")
    line = F.when(T.trim(raw).startswith("\\"), raw).when(marker != "", F.concat(F.lit("\\"), marker, F.when(text != "", F.concat(F.lit(" "), text)).otherwise(""))).when(text != "", text)
    return rows.select(*[c for c in ["book_code"] if c in rows.columns], "sequence_no", line.alias("line")).filter("line IS NOT NULL")


def write_markers(items: DataFrame, path: str) -> None:
    """A folder with one text file in sequence order for each book: the format is a single stream for a book."""
    lines = marker_lines(items if "book_code" in items.columns else items.withColumn("book_code", F.lit(None).cast("string")))
    lines.repartition("book_code").sortWithinPartitions("book_code", "sequence_no").select("book_code", "line").write.partitionBy("book_code").text(path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `no`, the place of each from 1 in the order of columns that together are unique.

    Rows are dealt to ranges; a range's numbers begin after the sizes of the ranges before it.  The
    bounds come from a small sample and decide only how even the ranges are.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.struct(*order)
    sample = sorted_sample(rows.select(*order), 20 * parts)
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    types = {f.name: f.dataType for f in rows.select(*order).schema}
    literal = lambda r: F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order])
    dealt = rows.withColumn("_part", F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= at)) if bounds else F.lit(0))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each range, not more than parts
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(before), "_part").withColumn("no", (F.col("_in") + F.col("_before")).cast("int")).drop("_part", "_in", "_before")


def sorted_sample(rows: DataFrame, n: int) -> list:
    """At most n rows, chosen by their hashes, in order."""
    drawn = rows.orderBy(F.xxhash64(*rows.columns)).limit(n)
    return drawn.orderBy(*rows.columns).collect()


def bilingual_table(items: DataFrame, by: str | None = None) -> DataFrame:
    """no, key, tags, chapter, verse, sub_tags, content_type, protection, english, translation of all items given.

    by: a column of items that names the file of each; `file` comes first then, and numbers begin anew in each.
    """
    rows = canonical(items, *([] if by is None else [F.col(by).alias("file")])).withColumn("seq", F.col("sequenceNo").cast("int"))
    of = [] if by is None else ["file"]
    key = T.filled(F.col("semanticKey"), F.col("matchKey"), F.concat_ws("|", "bookCode", "chapter", "verse", "contentType", "sequenceNo"))
    one = F.struct("marker", "chapter", "verse", "category", "contentType", "protectionLevel", "currentText")
    order = F.struct("seq", "currentText")
    role = F.col("languageRole")
    pick = lambda r: F.max_by(F.when(role == r, one), F.when(role == r, order)).alias(r)
    other = F.min_by(F.when(~role.isin("source", "target"), one), F.when(~role.isin("source", "target"), order)).alias("other")
    groups = rows.groupBy(*of, key.alias("key")).agg(F.min("seq").alias("seq"), pick("source"), pick("target"), other)
    r = F.coalesce("source", "target", "other")
    tag = F.when(r["marker"] == "", "").when(r["marker"].startswith("\\"), r["marker"]).otherwise(F.concat(F.lit("\\"), r["marker"]))
    out = numbered(groups, *of, "seq", "key")
    if of:
        firsts = out.groupBy("file").agg(F.min("no").alias("_first"))
        out = out.join(firsts, "file").withColumn("no", F.col("no") - F.col("_first") + 1)
    return out.select(*of, "no", "key", tag.alias("tags"), r["chapter"].alias("chapter"), r["verse"].alias("verse"), r["category"].alias("sub_tags"), r["contentType"].alias("content_type"), r["protectionLevel"].alias("protection"),
        F.coalesce("source.currentText", F.lit("")).alias("english"), F.coalesce("target.currentText", "other.currentText", F.lit("")).alias("translation"))


# The titles of the bilingual table, and the parts that a Word file has beside its document.
TITLES = ["Semantic Key", "No", "Tags", "Ch", "Vs", "Sub-Tags", "Content Type", "Protection", "English", "Translation"]
_NS = "http://schemas.openxmlformats.org"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = f'{_HEAD}<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = f'{_HEAD}<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_BEGIN, _FINISH = f'{_HEAD}<w:document xmlns:w="{_NS}/wordprocessingml/2006/main"><w:body><w:tbl>', "</w:tbl></w:body></w:document>"


def _table_row(cells: list[Column]) -> Column:
    """A table row; line feeds in a cell become breaks."""
    open_, close = '<w:t xml:space="preserve">', "</w:t>"

    def cell(c: Column) -> Column:
        text = F.regexp_replace(T.escape_xml(F.coalesce(c.cast("string"), F.lit(""))), "\r?\n", f"{close}<w:br/>{open_}")
        return F.concat(F.lit(f"<w:tc><w:p><w:r>{open_}"), text, F.lit(f"{close}</w:r></w:p></w:tc>"))

    return F.concat(F.lit("<w:tr>"), *map(cell, cells), F.lit("</w:tr>"))


def docx_pieces(items: DataFrame, by: str, rows: int = 2000, files: DataFrame | None = None) -> DataFrame:
    """file, member, nth, data: Word files of any size with a bilingual table, one for each value of the column `by`.

    Written in order of (member, nth), the pieces of a file are the file.  A table is compressed in chunks of
    `rows` rows, each by a task of its own.  files (file): those to write, also without items.
    """
    table = bilingual_table(items, by)
    chunk = F.floor((F.col("no") - 1) / rows)
    xml = _table_row([F.col(c) for c in ("key", "no", "tags", "chapter", "verse", "sub_tags", "content_type", "protection", "english", "translation")])
    chunks = table.select("file", chunk.alias("nth"), F.struct("no", xml.alias("xml")).alias("row")).groupBy("file", "nth").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    body = chunks.select("file", F.lit(2).alias("member"), F.lit("word/document.xml").alias("name"), (F.col("nth") + 1).alias("nth"), F.array_join(F.transform("rows", lambda x: x["xml"]), "").alias("text"))
    begin = F.concat(F.lit(_BEGIN), _table_row([F.lit(t) for t in TITLES]))
    fixed = [(0, "[Content_Types].xml", 0, F.lit(_TYPES)), (1, "_rels/.rels", 0, F.lit(_RELS)), (2, "word/document.xml", 0, begin), (2, "word/document.xml", 2**40, F.lit(_FINISH))]
    parts = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(name).alias("name"), F.lit(nth).cast("long").alias("nth"), text.alias("text")) for m, name, nth, text in fixed])
    files = items.select(F.col(by).alias("file")).distinct() if files is None else files
    every = body.union(files.select("file", F.explode(parts).alias("p")).select("file", "p.*"))
    return archive.zip_pieces(every.select("file", "member", "name", "nth", F.encode("text", "utf-8").alias("content")))


def docx_bytes(items: DataFrame) -> bytes:
    """The bytes of a Word file with the bilingual table of a bounded export, for a caller that wants them."""
    files = items.sparkSession.createDataFrame([("export",)], "file string")
    named = _bounded(items).withColumn("_file", F.lit("export"))
    return bytes(archive.small_files(docx_pieces(named, "_file", files=files)).first()["content"])


def append_absent(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose key is not stored yet, one for each key."""
    return new.join(stored.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
