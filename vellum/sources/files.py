"""Format detection and dispatch over a folder of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import markers, ranges, tables, word
from vellum.sources.items import finish

FORMATS = ("usfm", "sfm", "csv", "tsv", "json", "docx", "doc")


def format_of(name: Column, requested: str = "auto") -> Column:
    """The format by extension, whatever its case; null if there is none that is known."""
    if requested and requested != "auto":
        return F.lit(requested.lower())
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*FORMATS), ext)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, format, content, sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), format_of(F.col("path")).alias("format"), "content", F.sha2("content", 256).alias("sha256"))


def parse(files: DataFrame) -> DataFrame:
    """Items of all files, each by its format; files of unknown format give one row with a warning."""
    of = lambda *names: files.filter(F.col("format").isin(*names))
    marked = markers.parse(of("usfm", "sfm").select("file", ranges.text_of("content"))).withColumn("logical_key", F.col("semantic_key"))
    unknown = files.filter("format IS NULL").select("file", F.lit("unreadable").alias("content_type"), F.lit("unsupported format").alias("warning"), F.lit(None).cast("string").alias("current_text"), F.lit(None).cast("string").alias("semantic_key"))
    parts = [tables.parse_delimited(of("csv")), tables.parse_delimited(of("tsv"), "\t"), tables.parse_json(of("json")), word.parse_docx(of("docx", "doc")), marked, finish(unknown)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# The first pattern that a lower-case file name matches tells its resource role.
ROLE_PATTERNS = (
    ("cross|reference", "cross_references"),
    ("foot", "footnotes"),
    ("intro|back matter|glossary", "introductions"),
    ("map|chart", "maps_charts"),
    ("study|sub-heading|subheading", "study_notes"),
    (r"gsb.*\.(sfm|usfm)$", "source_scripture"),
    (r"(irv|tam).*\.(sfm|usfm)$", "target_scripture"),
)


def guess_role(name: Column, default: str = "other") -> Column:
    """The resource role that a file name suggests."""
    first, *more = [F.when(F.lower(name).rlike(pattern), role) for pattern, role in ROLE_PATTERNS]
    return F.coalesce(first, *more, F.lit(default))
