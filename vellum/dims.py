"""Small dimension tables and constants that results must agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Marker -> content type.
MARKER_TYPES = {
    "id": "book_id",
    "ide": "metadata", "usfm": "metadata",
    "h": "header", "h1": "header", "h2": "header", "h3": "header",
    "toc1": "toc", "toc2": "toc", "toc3": "toc",
    "mt": "book_title", "mt1": "book_title", "mt2": "book_title",
    "imt": "introduction_title", "imt1": "introduction_title", "imt2": "introduction_title",
    "is": "introduction_heading", "is1": "introduction_heading", "is2": "introduction_heading",
    "ip": "introduction", "ipi": "introduction", "im": "introduction", "imi": "introduction",
    "io": "outline", "io1": "outline", "io2": "outline", "io3": "outline",
    "ior": "outline_reference",
    "ili": "introduction_list", "ili1": "introduction_list", "ili2": "introduction_list",
    "c": "chapter", "cl": "chapter_label", "cp": "chapter_label",
    "v": "scripture",
    "s": "section_heading", "s1": "section_heading", "s2": "section_heading", "s3": "section_heading", "s4": "section_heading",
    "ms": "major_section", "ms1": "major_section", "ms2": "major_section", "mr": "major_section",
    "r": "parallel_reference",
    "p": "paragraph", "m": "paragraph", "mi": "paragraph", "pi": "paragraph", "pi1": "paragraph", "pi2": "paragraph", "pc": "paragraph", "pr": "paragraph", "nb": "paragraph",
    "q": "poetry", "q1": "poetry", "q2": "poetry", "q3": "poetry", "q4": "poetry", "qr": "poetry", "qc": "poetry",
    "b": "space",
    "esb": "study_block", "esbe": "study_block_end", "cat": "category",
    "fig": "figure",
}

# Book code and number of chapters, in canonical order.
CHAPTERS = {
    "GEN": 50, "EXO": 40, "LEV": 27, "NUM": 36, "DEU": 34, "JOS": 24, "JDG": 21, "RUT": 4, "1SA": 31, "2SA": 24, "1KI": 22,
    "2KI": 25, "1CH": 29, "2CH": 36, "EZR": 10, "NEH": 13, "EST": 10, "JOB": 42, "PSA": 150, "PRO": 31, "ECC": 12, "SNG": 8,
    "ISA": 66, "JER": 52, "LAM": 5, "EZK": 48, "DAN": 12, "HOS": 14, "JOL": 3, "AMO": 9, "OBA": 1, "JON": 4, "MIC": 7,
    "NAM": 3, "HAB": 3, "ZEP": 3, "HAG": 2, "ZEC": 14, "MAL": 4, "MAT": 28, "MRK": 16, "LUK": 24, "JHN": 21, "ACT": 28,
    "ROM": 16, "1CO": 16, "2CO": 13, "GAL": 6, "EPH": 6, "PHP": 4, "COL": 4, "1TH": 5, "2TH": 3, "1TI": 6, "2TI": 4,
    "TIT": 3, "PHM": 1, "HEB": 13, "JAS": 5, "1PE": 5, "2PE": 3, "1JN": 5, "2JN": 1, "3JN": 1, "JUD": 1, "REV": 22,
}

# Code point of the digit zero of each script whose digits are read as numbers.
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040)

# Content type, resource role, priority.
AUTHORITY = (
    ("scripture", "source_scripture", 1000),
    ("scripture", "target_scripture", 1000),
    ("scripture_fragment", "source_scripture", 1000),
    ("scripture_fragment", "target_scripture", 1000),
    ("footnote", "footnotes", 900),
    ("footnote", "source_scripture", 500),
    ("footnote", "target_scripture", 500),
    ("cross_reference", "cross_references", 900),
    ("cross_reference", "source_scripture", 500),
    ("cross_reference", "target_scripture", 500),
    ("study_note", "study_notes", 900),
    ("section_heading", "study_notes", 900),
    ("introduction", "introductions", 900),
    ("introduction_heading", "introductions", 900),
    ("introduction_title", "introductions", 900),
    ("outline", "introductions", 900),
    ("figure", "maps_charts", 900),
    ("docx_paragraph", "maps_charts", 900),
)

# Columns of the exchange form, in order.
HEADERS = (
    "semanticKey", "matchKey", "parentSemanticKey", "bookCode", "chapter", "verse", "contentType", "marker", "category",
    "sequenceNo", "languageCode", "languageRole", "protectionLevel", "reviewStatus", "currentText", "rawText", "sourceLocator", "resourceRole",
)

# Names that enter fingerprints and files.
ENGINE = "local-deterministic-v0.4"
EXCHANGE_VERSION = "sbc-0.4"

# Types whose records may match across resources, types that are translated, severities.
MATCHED_TYPES = ("scripture", "scripture_fragment", "footnote", "cross_reference", "study_note", "section_heading", "introduction", "introduction_heading", "introduction_title", "outline", "figure")
TRANSLATED_TYPES = ("study_note", "section_heading", "footnote", "cross_reference", "introduction", "introduction_heading", "introduction_title", "outline", "major_section", "parallel_reference")
SEVERITIES = ("critical", "high", "medium", "low", "info")


def marker_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MARKER_TYPES.items()), "marker string, content_type string")


def chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHAPTERS.items()), "book_code string, max_chapter int")


def authority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AUTHORITY), "content_type string, resource_role string, priority int")
