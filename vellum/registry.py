"""All registered queries of the library, without the optional training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import dims
from vellum.dims import HEADERS
from vellum.functions import text as T
from vellum.operators import importing, pages, pairing, quality, scans, summaries
from vellum.plans import oracles
from vellum.plans.shared_sql import DOCUMENTS, EXISTING, EXISTING_MORE, FILE_NAMES, INCOMING, INCOMING_MORE, ITEMS, view
from vellum.sinks import archive, exchange
from vellum.sources import files, markers, tables, word

_QUERIES = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark, sf_dir):
    return view(spark, sf_dir, ITEMS, "conversations")


def _documents(spark, sf_dir):
    return view(spark, sf_dir, DOCUMENTS, "documents")


def _import_sides(spark, sf_dir):
    sides = (INCOMING, INCOMING_MORE), (EXISTING, EXISTING_MORE)
    return [view(spark, sf_dir, f"SELECT *, {more} FROM ({sql}) AS side", "documents").withColumn("content_hash", T.content_hash(F.col("current_text"))) for sql, more in sides]


@query
def normalize_hash(spark, sf_dir):
    norm = T.normalize(F.col("current_text"))
    return _documents(spark, sf_dir).select("doc_id", norm.alias("norm")).select("doc_id", F.length("norm").alias("n"), F.sha2("norm", 256).alias("content_hash"))


@query
def duplicate_identity(spark, sf_dir):
    """Documents with the same normalised text; hashes are shuffled, not texts."""
    hashed = _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query
def exact_dup_probe(spark, sf_dir):
    """Texts as files: those of even ids are stored, which of the others are new for their language?"""
    files = _table(spark, sf_dir, "documents").select("doc_id", F.lit("source").alias("resource_role"), F.when(F.col("lang") != "fr", F.col("lang")).alias("language_code"), F.encode("text", "utf-8").alias("content"))
    known = files.filter("doc_id % 2 = 0").withColumn("sha256", F.sha2("content", 256))
    return importing.new_files(files.filter("doc_id % 2 = 1"), known).select("doc_id", "sha256", "language_code")


@query
def stats_totals(spark, sf_dir):
    return summaries.totals(_documents(spark, sf_dir))


@query
def stats_by_type(spark, sf_dir):
    return summaries.by_type(_documents(spark, sf_dir))


@query
def project_counts(spark, sf_dir):
    projects = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    books = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"))
    items = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"))
    return summaries.project_counts(projects, books, items)


@query
def book_summary(spark, sf_dir):
    books = spark.sql("SELECT concat('B', CAST(id AS STRING)) AS book_code FROM range(12)")
    return summaries.book_summary(books, _documents(spark, sf_dir))


@query
def chapter_summary(spark, sf_dir):
    return summaries.chapter_summary(_documents(spark, sf_dir))


@query
def browse_page(spark, sf_dir):
    """The second page of the browser's default view, with a priority joined (0 where there is none)."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    page = summaries.browse(_documents(spark, sf_dir), limit=300, offset=300).join(labels, "doc_id", "left")
    return page.select("id", "book_code", "chapter", "sequence_no", "language_code", F.coalesce("quality", F.lit(0)).alias("priority"))


@query
def browse_page_deep(spark, sf_dir):
    """A page far behind, by a directory of sorted ranges: only the ranges that hold it are read."""
    path = f"{scans.shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.write(_documents(spark, sf_dir).drop("current_text"), path, size=200)
    return pages.page(spark, path, limit=300, offset=650).select("place", "id", "book_code", "chapter", "sequence_no")


@query
def pairs(spark, sf_dir):
    rows = pairing.pivot(_items(spark, sf_dir), ["id", "current_text"])
    return rows.select("key", F.col("source.id").alias("source_id"), F.col("target.id").alias("target_id"), F.sha2("source.current_text", 256).alias("source_hash"), F.sha2("target.current_text", 256).alias("target_hash"), "n")


@query
def pairs_page(spark, sf_dir):
    """A page of pairs of one book and type: keys are limited before their records are fetched."""
    rows = pairing.list_pairs(_items(spark, sf_dir), ["id"], limit=20, book_code="PSA", content_type="study_note")
    return rows.select("key", F.col("source.id").alias("source_id"), F.col("target.id").alias("target_id"), "first_chapter", "first_seq")


@query
def one_sided(spark, sf_dir):
    return pairing.one_sided(pairing.pivot(_items(spark, sf_dir), ["id"])).select("key", "side", F.coalesce("source.id", "target.id").alias("id"))


ISSUE = quality.COLUMNS[:6]


def _rule(make, *categories):
    def run(spark, sf_dir):
        return make(_items(spark, sf_dir)).filter(F.col("category").isin(*categories)).select(*ISSUE)

    return run


#: query -> (rules evaluated together, categories).
RULES = {
    "unicode_checks": (quality.record_findings, ("unicode_zero_width", "unicode_replacement_character", "invalid_control_character", "unicode_normalization")),
    "marker_spacing": (quality.record_findings, ("usfm_marker_spacing",)),
    "marker_balance": (quality.record_findings, ("usfm_marker_balance",)),
    "anchor_range": (quality.record_findings, ("invalid_chapter_anchor",)),
    "number_mismatch": (quality.pair_findings, ("number_mismatch",)),
    "empty_target": (quality.pair_findings, ("empty_target_content",)),
    "marker_sequence": (quality.pair_findings, ("usfm_marker_sequence_mismatch",)),
    "versification": (quality.pair_findings, ("versification_difference",)),
    "duplicate_record": (quality.duplicate_findings, ("duplicate_canonical_record",)),
}
_QUERIES |= {name: _rule(make, *categories) for name, (make, categories) in RULES.items()}


@query
def qa_issues(spark, sf_dir):
    return quality.findings(_items(spark, sf_dir)).select(*ISSUE)


@query
def qa_details(spark, sf_dir):
    """What each finding says, and its evidence as JSON."""
    return quality.findings(_items(spark, sf_dir)).select("fingerprint", "message", "evidence", "suggested_text")


def _issues(spark, sf_dir):
    """Findings as an issue table: those of severity info are accepted, the age is a rule on the fingerprint."""
    status = F.when(F.col("severity") == "info", "accepted").otherwise("open")
    return quality.findings(_items(spark, sf_dir)).withColumns({"status": status, "created_at": F.conv(F.substring("fingerprint", 1, 6), 16, 10).cast("int")})


@query
def qa_result(spark, sf_dir):
    issues = _issues(spark, sf_dir)
    return quality.result(issues, issues)


@query
def issue_page(spark, sf_dir):
    """Open issues of one severity, the newest first."""
    rows = quality.list_issues(_issues(spark, sf_dir), _items(spark, sf_dir), limit=100, severity="high", status="open")
    return rows.select("fingerprint", "rank", "category", "created_at", "book_code", "verse")


@query
def qa_summary(spark, sf_dir):
    return quality.summary(quality.findings(_items(spark, sf_dir)))


@query
def issue_list(spark, sf_dir):
    items = _items(spark, sf_dir)
    rows = quality.list_issues(quality.findings(items), items, limit=200)
    return rows.select("fingerprint", "rank", "category", "content_item_id", "book_code", "chapter", F.sha2("paired_text", 256).alias("paired_hash"))


@query
def vocabulary_topk(spark, sf_dir):
    return summaries.vocabulary(_documents(spark, sf_dir), "en", 80)


@query
def vocabulary_locale(spark, sf_dir):
    return summaries.vocabulary(_documents(spark, sf_dir), "fr", 80, locale=True)


@query
def import_classify(spark, sf_dir):
    rows = importing.classify(*_import_sides(spark, sf_dir))
    return rows.select("id", "logical_key", "resource_role", "status", "cross_role", "anchor_id", "old_role", "recommendation")


@query
def conflict_reasons(spark, sf_dir):
    return importing.classify(*_import_sides(spark, sf_dir)).filter("status = 'conflict'").select("id", "recommendation", "reason", "protected")


@query
def preview_languages(spark, sf_dir):
    return importing.language_breakdown(_import_sides(spark, sf_dir)[0])


@query
def preview_examples(spark, sf_dir):
    """The eight conflicts that a preview shows."""
    return importing.preview(*_import_sides(spark, sf_dir))[2]


def _files(spark, sf_dir):
    """Seven incoming files of three batches."""
    return spark.sql("SELECT concat('f', id) AS file_id, concat('b', id % 3) AS batch_id, concat('file ', id) AS filename, CASE WHEN id % 4 < 3 THEN 'en' END AS language_code, 'notes' AS resource_role FROM range(8)")


@query
def commit_books(spark, sf_dir):
    return importing.committed_books(_import_sides(spark, sf_dir)[0], spark.sql("SELECT 'GEN' AS book_code"))


@query
def commit_resources(spark, sf_dir):
    return importing.committed_resources(_files(spark, sf_dir), _import_sides(spark, sf_dir)[0])


@query
def commit_batches(spark, sf_dir):
    incoming, existing = _import_sides(spark, sf_dir)
    return importing.committed(_files(spark, sf_dir), incoming, existing, spark.sql("SELECT 'GEN' AS book_code"))["batches"]


@query
def authority_rules(spark, sf_dir):
    """All rules, with how many items each one concerns."""
    return importing.authority_rules(spark, _items(spark, sf_dir))


@query
def role_guess(spark, sf_dir):
    return view(spark, sf_dir, FILE_NAMES, "supplier").select("s_suppkey", files.guess_role(F.col("filename")).alias("role"))


@query
def import_summary(spark, sf_dir):
    return importing.summarize(importing.classify(*_import_sides(spark, sf_dir), within=False))


@query
def conflict_list(spark, sf_dir):
    incoming, existing = _import_sides(spark, sf_dir)
    rows = importing.list_conflicts(importing.commit(incoming, existing)[1], existing)
    return rows.select("conflict_id", "incoming_id", "anchor_id", "incoming_role", "existing_role", "recommendation", "rank", F.sha2("existing_text", 256).alias("existing_hash"))


@query
def conflict_center(spark, sf_dir):
    """Conflicts with the stored record, its resource and the incoming file."""
    incoming, existing = _import_sides(spark, sf_dir)
    resources = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("resource_id"), F.col("n_name").alias("title"))
    rows = importing.list_conflicts(importing.commit(incoming, existing)[1], existing, resources=resources, files=_files(spark, sf_dir))
    return rows.select("conflict_id", "rank", "created_at", "existing_resource", "incoming_filename", "existing_marker", "review_status", "book_code", "chapter", F.sha2("existing_raw_text", 256).alias("existing_raw_hash"), "reason")


@query
def conflict_rollup(spark, sf_dir):
    return importing.conflict_rollup(importing.commit(*_import_sides(spark, sf_dir))[1])


def _resolved(spark, sf_dir):
    """Every conflict is decided by a rule on its recommendation."""
    incoming, existing = _import_sides(spark, sf_dir)
    conflicts = importing.commit(incoming, existing)[1]
    action = F.when(F.col("recommendation") == "manual_review", "manual_merge").otherwise(F.col("recommendation"))
    decisions = conflicts.select(
        "conflict_id", action.alias("action"), F.when(F.col("content_type") != "figure", F.lit("checked")).alias("reason"), F.concat(F.lit("merged "), "incoming_id").alias("merged_text"),
        (F.length("incoming_text") % 2 == 0).alias("confirm_protected"), F.concat(F.lit("editor "), "incoming_id").alias("actor"), F.col("created_at").alias("decided_at"),
    )
    # some items have been changed four times before
    versions = existing.filter("sequence_no % 3 = 0").select(F.col("id").alias("content_item_id"), F.lit(4).alias("revision_no"), F.lit("before").alias("text"), F.lit("manual_merge").alias("change_type"), F.lit("earlier").alias("reason"))
    return importing.resolve(conflicts, existing, versions, decisions)


@query
def resolve_next_state(spark, sf_dir):
    """The items that follow from all decisions."""
    return _resolved(spark, sf_dir)[0].select("id", "review_status", F.sha2("current_text", 256).alias("text_hash"))


@query
def resolve_places(spark, sf_dir):
    """The items' resources and places after all decisions."""
    return _resolved(spark, sf_dir)[0].select("id", "resource_id", "source_locator")


@query
def resolve_conflicts(spark, sf_dir):
    """The conflicts after all decisions."""
    return _resolved(spark, sf_dir)[1].select("conflict_id", "status", "resolution_reason", "resolved_by", "resolved_at")


@query
def resolve_versions(spark, sf_dir):
    """The texts that the decisions have replaced, numbered on from the stored versions."""
    return _resolved(spark, sf_dir)[2].select("content_item_id", "revision_no", F.sha2("text", 256).alias("text_hash"), "change_type", "reason")


@query
def resolve_refused(spark, sf_dir):
    return _resolved(spark, sf_dir)[3]


@query
def project_stats(spark, sf_dir):
    books = spark.sql("SELECT concat('B', CAST(id AS STRING)) AS book_code FROM range(12)")
    known = view(spark, sf_dir, FILE_NAMES, "supplier").select("filename", F.col("s_suppkey").alias("byte_size"))
    return summaries.project_stats(_documents(spark, sf_dir), books, known, _issues(spark, sf_dir), importing.commit(*_import_sides(spark, sf_dir))[1])


@query
def export_rows(spark, sf_dir):
    """Active items of one language and resource role, with the resource's title."""
    items = _items(spark, sf_dir).withColumns({"resource_id": F.concat(F.lit("n"), F.col("sequence_no") % 25), "canonical_state": F.when(F.col("sequence_no") % 10 == 9, "retired").otherwise("active")})
    resources = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("resource_id"), F.when(F.col("n_nationkey") % 2 == 0, "study_notes").otherwise("footnotes").alias("resource_role"), F.col("n_name").alias("title"))
    rows = exchange.export_rows(items, resources, language_code="ta", resource_role="study_notes")
    return rows.select("id", "book_code", "chapter", "sequence_no", "resource_title")


#: Columns that the parser queries return.
PARSED = ["file", "book_code", "chapter", "verse", "content_type", "marker", "sequence_no", "semantic_key", "match_key", "current_text", "language_role", "source_locator"]


def _in_ranges(rows, file, number, text, separator, size=256):
    """file, range, nth, piece: a large file for each value of `file`, as pieces over many tasks; rows in order of their number."""
    each = rows.select(F.col(file).alias("file"), F.floor(F.col(number) / size).alias("range"), F.col(number).alias("number"), F.posexplode(F.split(text, separator)).alias("part", "piece"))
    nth = F.row_number().over(Window.partitionBy("file", "range").orderBy("number", "part")) - 1
    return each.select("file", "range", nth.cast("long").alias("nth"), "piece")


def _part_lines(spark, sf_dir, delimiter):
    """One delimited file for each brand: quotes, line feeds and delimiters inside cells, loose titles."""
    parts = _table(spark, sf_dir, "part")
    cell = F.concat(F.lit('"say ""'), "p_name", F.lit(f'""{delimiter}\n'), "p_size", F.lit('"'))
    line = F.concat_ws(delimiter, F.concat(F.lit("P|"), "p_partkey"), F.lit("MAT"), F.col("p_size").cast("string"), F.lit("1-2"), F.lit("\\s"), cell)
    titles = delimiter.join(["semantic_key", "Book", "Ch", "Vs", "Tags", "Translation"])
    first = parts.select(F.col("p_brand").alias("file"), F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("nth"), F.lit(titles + "\r").alias("piece")).distinct()
    return first.union(_in_ranges(parts, "p_brand", "p_partkey", F.concat(line, F.lit("\r")), "\n"))


@query
def csv_items(spark, sf_dir):
    """Large CSV files as lines over many tasks; records of two lines."""
    return tables.parse_delimited_lines(_part_lines(spark, sf_dir, ",")).select(*PARSED)


@query
def tsv_items(spark, sf_dir):
    return tables.parse_delimited_lines(_part_lines(spark, sf_dir, "\t"), "\t").select(*PARSED)


@query
def json_items(spark, sf_dir):
    """A large JSON file for each brand, cut at braces: arrays, and objects with items; braces in strings and objects inside records."""
    parts = _table(spark, sf_dir, "part")
    inner = F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit('"}{').alias("odd"), F.struct("p_size").alias("more")))
    record = F.struct(F.concat(F.lit("P|"), "p_partkey").alias("semanticKey"), F.lit("MRK").alias("book"), F.col("p_size").alias("chapter"), F.concat("p_name", F.lit(" }")).alias("text"), F.lit("source").alias("languageRole"), inner.alias("inner"))
    # behind the last brace of a record begins the next piece
    each = _in_ranges(parts, "p_brand", "p_partkey", F.concat(F.lit(","), F.regexp_replace(F.to_json(record), r"\}$", "")), r"\}")
    brands = parts.select(F.col("p_brand").alias("file")).distinct()
    array = F.crc32(F.col("file").cast("binary")) % 2 == 0
    piece = lambda at, nth, text: brands.select("file", F.lit(at).cast("long").alias("range"), F.lit(nth).cast("long").alias("nth"), text.alias("piece"))
    first = piece(-1, 0, F.concat(F.when(array, "[").otherwise('{"schemaVersion":1,"items":['), F.lit('{"text":"first"')))
    last = piece(2**62, 0, F.when(array, F.lit("]")).otherwise(F.lit('],"end":0'))).union(piece(2**62, 1, F.lit("")).filter(~array))
    return tables.parse_json_pieces(first.union(each).union(last)).select(*PARSED)


@query
def docx_items(spark, sf_dir):
    """Word files with 60 bilingual rows each, written in chunks of 16 rows, and read."""
    customer = _table(spark, sf_dir, "customer").withColumn("file", F.concat(F.lit("book/MAT-notes-"), F.floor(F.col("c_custkey") / 60), F.lit(".docx")))
    sides = [
        customer.selectExpr("file", "concat('N|', c_custkey) AS semantic_key", f"c_custkey * 2 + {k} AS sequence_no", "c_nationkey % 5 + 1 AS chapter", "'3' AS verse", "'footnote' AS content_type", "'f' AS marker", f"'{role}' AS language_role", f"concat(c_name, ' & <{role}> \"x\"\n2') AS current_text")
        for k, role in enumerate(("source", "target"))
    ]
    pieces = exchange.docx_pieces(sides[0].union(sides[1]), "file", rows=16)
    return word.parse_docx(archive.small_files(pieces)).select(*PARSED)


@query
def duplicate_members(spark, sf_dir):
    """All records of repeated identities, however many an identity has."""
    return quality.duplicate_members(_items(spark, sf_dir))


@query
def noted_usfm_items(spark, sf_dir):
    """Line-marker files with closed and open notes, attributes, native digits and plain lines, one for each nation."""
    content = r"concat('\ufeff\\id JON ', n_name, '\r\n\\c 1\r\n\\v 1 Before \\f + \\ft note ', n_name, '\\f* after \\w word|x-a=\"1\"\\w*\n\\v 2-3 Open \\x + \\xt Gen 1:1\nplain ', n_name, '\n\\s1 Head \u0be7\n')"
    text = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("file"), F.expr(content).alias("content"))
    return markers.parse(text).select(*[c for c in PARSED if c != "language_role"], "parent_semantic_key", "warning", F.array_join(T.numbers(F.col("current_text")), ",").alias("numbers"))


def _order_lines(spark, sf_dir):
    """Line-marker files as lines in ranges: books, chapters and verses carry over ranges, keys are numbered over the file."""
    k = F.col("o_orderkey")
    parts = [
        F.when(k % 2000 == 0, F.concat(F.lit("\\id "), F.element_at(F.array(F.lit("gen"), F.lit("exo"), F.lit("lev")), (F.floor(k / 2000) % 3 + 1).cast("int")), F.lit(" Orders"))),
        F.when(k % 10 == 0, F.concat(F.lit("\\c "), F.col("o_custkey") % 40 + 1)),
        F.concat(F.lit("\\v "), k % 5, F.lit(" "), "o_orderstatus", F.lit(" of "), "o_custkey", F.when(k % 3 == 0, F.concat(F.lit(" \\f + \\ft note "), k, F.lit("\\f*"))).otherwise("")),
        F.concat(F.lit("\\s1 "), "o_orderstatus"),
    ]
    return _in_ranges(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", F.concat_ws("\n", *parts), "\n").withColumnRenamed("piece", "line")


@query
def usfm_items(spark, sf_dir):
    """A large line-marker file for each priority, over many tasks."""
    return markers.parse_lines(_order_lines(spark, sf_dir)).select("file", "sequence_no", "content_type", "chapter", "verse", "semantic_key", "match_key", "current_text", "content_hash", "source_locator")


@query
def parser_statistics(spark, sf_dir):
    """For each file its chapters, verses, and items by type."""
    found = markers.statistics(markers.parse_lines(_order_lines(spark, sf_dir)))
    by_type = F.array_join(F.transform(F.array_sort(F.map_entries("stats")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("file", F.array_join("chapters", ",").alias("chapters"), "verses", by_type.alias("stats"))


@query
def file_formats(spark, sf_dir):
    return view(spark, sf_dir, FILE_NAMES, "supplier").select("s_suppkey", files.format_of(F.col("filename")).alias("format"))


@query
def mixed_files(spark, sf_dir):
    """A small file for each supplier, of all formats, read by the dispatcher."""
    n = F.col("s_suppkey") % 6
    text = (
        F.when(n == 0, F.concat(F.lit("\\id GEN\n\\c 1\n\\v 1 "), "s_name"))
        .when(n == 1, F.concat(F.lit("Book,text\nGEN,"), "s_name"))
        .when(n == 2, F.concat(F.lit("Book\ttext\nGEN\t"), "s_name"))
        .when(n == 3, F.concat(F.lit('{"items":[{"text":"'), "s_name", F.lit('"}]}')))
        .when(n == 4, F.concat(F.lit("Book,text\nGEN,\""), "s_name"))
        .otherwise("none")
    )
    ending = F.element_at(F.array(*map(F.lit, ("sfm", "CSV", "tsv", "Json", "csv", "pdf"))), (n + 1).cast("int"))
    named = _table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("."), ending).alias("file"), F.encode(text, "utf-8").alias("content"))
    parsed = files.parse(named.withColumn("format", files.format_of(F.col("file"))))
    return parsed.select("file", "content_type", "semantic_key", "current_text", "warning")


@query
def canonical_csv_items(spark, sf_dir):
    """Files with all 18 headers, in which loose titles count for nothing."""
    parts = _table(spark, sf_dir, "part")
    value = {"semanticKey": F.concat(F.lit("P|"), "p_partkey"), "bookCode": F.lit("MAT"), "chapter": F.col("p_size").cast("string"), "verse": F.lit("4"), "contentType": F.when(F.col("p_partkey") % 2 == 0, "footnote").otherwise(""), "currentText": F.col("p_name"), "languageRole": F.lit("source"), "resourceRole": F.lit("footnotes")}
    line = F.concat_ws(",", *[value.get(h, F.lit("")) for h in HEADERS], F.lit("ignored"))
    first = parts.select(F.col("p_brand").alias("file"), F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("nth"), F.lit(",".join([*HEADERS, "text"])).alias("piece")).distinct()
    rows = tables.parse_delimited_lines(first.union(_in_ranges(parts, "p_brand", "p_partkey", line, "\n")))
    return rows.select(*PARSED, "resource_role", "protection_level", "raw_text")


@query
def docx_types(spark, sf_dir):
    """Word files that state no content type: it follows from the tag."""
    tag = F.element_at(F.array(*map(F.lit, ("f", "x", "s1", "c", "v", "fig", "ef", "p"))), (F.col("s_suppkey") % 8 + 1).cast("int"))
    items = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PSA "), F.floor(F.col("s_suppkey") / 30), F.lit(".docx")).alias("file"), F.concat(F.lit("S|"), "s_suppkey").alias("semantic_key"), F.col("s_suppkey").cast("int").alias("sequence_no"),
        F.lit(1).alias("chapter"), F.lit("2").alias("verse"), F.lit("").alias("content_type"), tag.alias("marker"), F.lit("source").alias("language_role"), F.col("s_name").alias("current_text"),
    )
    rows = word.parse_docx(archive.small_files(exchange.docx_pieces(items, "file")))
    return rows.select("file", "semantic_key", "book_code", "content_type", "marker", "language_role", "current_text")


@query
def json_export(spark, sf_dir):
    """A JSON export of any size, an item a piece."""
    customer = _table(spark, sf_dir, "customer").selectExpr("concat('C|', c_custkey) AS semantic_key", "CAST(c_custkey AS INT) AS sequence_no", "c_name AS current_text", "concat('\"', c_mktsegment, '\" \\\\ /') AS raw_text", "'en' AS language_code")
    return exchange.json_pieces(customer, "2024-01-01T00:00:00.000Z")


@query
def marker_export(spark, sf_dir):
    """Line-marker text of all items; the raw line where there is one, else marker and text."""
    items = _items(spark, sf_dir).withColumns({"raw_text": F.when(F.col("sequence_no") % 3 == 0, F.concat(F.lit(" \\p "), "raw_text")).otherwise(""), "marker": F.when(F.col("sequence_no") % 5 > 0, F.col("marker")), "source_locator": F.when(F.col("sequence_no") % 7 == 0, "line:3:footnote").otherwise(F.col("source_locator"))})
    lines = exchange.marker_lines(items)
    return lines.select("book_code", "sequence_no", F.sha2("line", 256).alias("line_hash"))


@query
def absent_keys(spark, sf_dir):
    """Customers of orders that are not stored yet, each once."""
    new = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    known = _table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("custkey"))
    return exchange.append_absent(new, known, "custkey")


def _earlier_issues(spark, sf_dir):
    """Issues before a run: some have not been found yet, some are a person's, some are closed."""
    f = F.col("fingerprint")
    found = _issues(spark, sf_dir).filter(~f.startswith("f"))
    return found.withColumns({"engine": F.when(f.startswith("0"), "person").otherwise(dims.ENGINE), "status": F.when(f.startswith("1"), "rejected").otherwise(F.col("status"))})


@query
def issues_next(spark, sf_dir):
    """The issue table after a run: open findings of the engine are replaced, closed ones and a person's stay."""
    return quality.next_issues(_earlier_issues(spark, sf_dir), _items(spark, sf_dir)).select("fingerprint", "status", "engine", "category")


@query
def issue_status(spark, sf_dir):
    """One issue is deferred."""
    issues = _issues(spark, sf_dir).select("fingerprint", "status")
    return quality.set_status(issues, issues.agg(F.min("fingerprint")).first()[0], "deferred")


@query
def rules_listed(spark, sf_dir):
    rules = _table(spark, sf_dir, "part").selectExpr("p_partkey AS rule_id", "CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'proposed' END AS status", "p_size AS evidence_count")
    return summaries.listed_rules(rules, "rule_id")


@query
def clean_cells(spark, sf_dir):
    """Table cells: NFC, spaces collapsed, line feeds kept, NA and N/A empty."""
    cell = F.when(F.col("doc_id") % 9 == 0, F.lit(" n/A ")).otherwise(F.concat(F.lit("  \r"), "current_text", F.lit("  \n  end \ufeff")))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(T.clean_cell(cell), 256).alias("cell_hash"))


@query
def resolved_languages(spark, sf_dir):
    """Role and code of items by what the item, its file and its resource say."""
    items = _table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'target' END AS language_role", "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '' END AS file_language",
        "CASE doc_id % 5 WHEN 0 THEN 'source_scripture' WHEN 1 THEN 'target' WHEN 2 THEN 'sourcebook' ELSE 'notes' END AS resource_role",
    )
    return importing.resolve_language(items, "en", "fr").select("doc_id", "language_role", "language_code")


@query
def fresh_ids(spark, sf_dir):
    """New identifiers differ, and have their form; so has the time."""
    rows = _table(spark, sf_dir, "documents").select(T.new_id("cnt").alias("id"), T.iso_now().alias("at"))
    good = F.col("id").rlike("^cnt_[0-9a-f]{32}$") & F.col("at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}\.[0-9]{3}Z$")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.count_if(good).alias("n_good"))


@query
def project_lookup(spark, sf_dir):
    projects = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    books = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"))
    items = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"))
    return summaries.project_counts(projects, books, items).filter("project_id = 7")


def generated_book(spark: SparkSession, books: int = 1) -> DataFrame:
    """file, content of generated line-marker books."""
    verse = "concat('\\\\v ', v, ' Performance verse ', c, ':', v, ' with repeated words for vocabulary and publishing checks.')"
    chapter = f"concat('\\\\c ', c, '\\n', array_join(transform(sequence(1, 100), v -> {verse}), '\\n'))"
    return spark.sql(f"SELECT concat('book', id) AS file, concat('\\\\id PSA Performance fixture\\n', array_join(transform(sequence(1, 50), c -> {chapter}), '\\n'), '\\n') AS content FROM range({int(books)})")


@query
def html_extract(spark, sf_dir):
    """Title and headings of pages, entities decoded."""
    html = F.col("html")
    first = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    heads = F.regexp_extract_all(html, F.lit("<h1>([^<]*)</h1>"), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", T.unescape_xml(first).alias("title"), F.array_join(F.transform(heads, T.unescape_xml), "|").alias("headings"))


@query
def canonical_export(spark, sf_dir):
    return exchange.canonical(_items(spark, sf_dir))


@query
def csv_export(spark, sf_dir):
    items = _documents(spark, sf_dir).withColumns({"semantic_key": F.col("id"), "raw_text": F.lit('say "so", or\nnot')})
    return exchange.delimited_lines(items)


@query
def bilingual_export(spark, sf_dir):
    """Numbered bilingual rows of all books."""
    return exchange.bilingual_table(_items(spark, sf_dir))


@query
def publication_gate(spark, sf_dir):
    return summaries.publication_gate(_items(spark, sf_dir), importing.commit(*_import_sides(spark, sf_dir))[1], _issues(spark, sf_dir))


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
