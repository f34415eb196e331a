"""Browse pages, totals, summaries and vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T


def _where(df: DataFrame, equal: dict) -> DataFrame:
    for name, value in equal.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def totals(items: DataFrame) -> DataFrame:
    is_ = lambda c, v: F.sum(F.when(F.col(c) == v, 1).otherwise(0))
    return items.agg(F.count("*").alias("items"), is_("protection_level", "protected_scripture").alias("protected"), is_("review_status", "approved").alias("approved"))


def by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("content_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "content_type")


def book_summary(books: DataFrame, items: DataFrame) -> DataFrame:
    """Every book, also those without an item.  Items are summed before the join, which then moves one row a book."""
    protected = F.sum(F.when(F.col("protection_level") == "protected_scripture", 1).otherwise(0))
    sums = items.groupBy("book_code").agg(F.count("*").alias("item_count"), F.countDistinct("chapter").alias("chapter_count"), protected.alias("scripture_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return books.join(sums, "book_code", "left").select(*books.columns, zero("item_count"), zero("chapter_count"), zero("scripture_count"))


def chapter_summary(items: DataFrame, book_code: str | None = None) -> DataFrame:
    rows = _where(items, {"book_code": book_code}).filter("chapter IS NOT NULL")
    protected = F.sum(F.when(F.col("protection_level") == "protected_scripture", 1).otherwise(0))
    return rows.groupBy("book_code", "chapter").agg(F.count("*").alias("item_count"), protected.alias("scripture_count"))


def browse(items: DataFrame, resources: DataFrame | None = None, limit: int = 300, offset: int = 0, **equal) -> DataFrame:
    """One page in book, chapter and sequence order; the page is cut before resources are joined."""
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000 and offset not negative")
    order = [F.asc_nulls_first("book_code"), F.asc_nulls_first("chapter"), "sequence_no", "id"]
    page = _where(items, equal).orderBy(*order).offset(offset).limit(limit)
    return page if resources is None else page.join(resources, "resource_id", "left")


def project_counts(projects: DataFrame, books: DataFrame, items: DataFrame) -> DataFrame:
    """projects with how many books and items each has."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = projects.join(count(books, "book_count"), "project_id", "left").join(count(items, "item_count"), "project_id", "left")
    return out.fillna(0, ["book_count", "item_count"])


def vocabulary(items: DataFrame, language_code: str | None = None, limit: int = 80, locale: bool = False) -> DataFrame:
    """The most frequent words; ties in code-point order, or in root-locale order."""
    if not 0 < limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    rows = _where(items, {"language_code": language_code}).filter("current_text <> ''")
    counts = rows.select(F.explode(T.words(F.col("current_text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.collate("word", "UNICODE") if locale else F.col("word")).limit(limit)


def publication_gate(items: DataFrame, conflicts: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: what is open, and whether all may be published."""
    a = items.agg(F.count("*").alias("items"))
    b = conflicts.agg(F.count_if(F.col("status") == "pending").alias("pending_conflicts"))
    open_ = F.col("status") == "open"
    c = issues.agg(F.count_if(open_).alias("open_issues"), F.count_if(open_ & (F.col("severity") == "critical")).alias("critical_issues"), F.count_if(open_ & (F.col("severity") == "high")).alias("high_issues"))
    one = a.join(b).join(c)  # three tables of one row
    return one.withColumn("ready", (F.col("items") > 0) & (F.col("pending_conflicts") == 0) & (F.col("open_issues") == 0))


def listed_rules(rules: DataFrame, *ties: str) -> DataFrame:
    """Editorial rules or glossary terms, approved ones first."""
    return rules.orderBy((F.col("status") == "approved").desc(), F.desc("evidence_count"), *ties).limit(500)


def newest_first(rows: DataFrame, at: str, *ties: str) -> DataFrame:
    """Files or projects, the last one first."""
    return rows.orderBy(F.desc(at), *ties)


def project_stats(items: DataFrame, books: DataFrame, files: DataFrame, issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    """section, name, n of one project: totals, items by type, items and chapters by book, bytes by file, open issues by severity, pending conflicts."""
    row = lambda section, name, n: [F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n")]
    unpivot = lambda df, section, names: df.select(F.explode(F.array(*[F.struct(*row(section, F.lit(c), F.coalesce(F.col(c), F.lit(0)))) for c in names])).alias("r")).select("r.*")
    of_books = book_summary(books, items)
    parts = [
        unpivot(totals(items), "totals", ["items", "protected", "approved"]),
        items.groupBy("content_type").agg(F.count("*").alias("n")).select(*row("type", F.col("content_type"), F.col("n"))),
        of_books.select(*row("book items", F.col("book_code"), F.col("item_count"))),
        of_books.select(*row("book chapters", F.col("book_code"), F.col("chapter_count"))),
        files.select(*row("file", F.col("filename"), F.col("byte_size"))),
        issues.filter("status = 'open'").groupBy("severity").agg(F.count("*").alias("n")).select(*row("open issues", F.col("severity"), F.col("n"))),
        conflicts.agg(F.count_if(F.col("status") == "pending").alias("n")).select(*row("conflicts", F.lit("pending"), F.col("n"))),
    ]
    return reduce(DataFrame.union, parts)
