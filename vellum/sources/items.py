"""The canonical item as the file readers emit it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

#: What the Python readers fill in; hashes and keys derived from text are added by `finish` in the JVM.
SCHEMA = (
    "file string, book_code string, chapter int, verse string, content_type string, marker string, category string, sequence_no int, "
    "semantic_key string, match_key string, parent_semantic_key string, raw_text string, current_text string, protection_level string, "
    "source_locator string, language_role string, language_code string, resource_role string, warning string"
)


def finish(items: DataFrame) -> DataFrame:
    norm = T.normalize(F.col("current_text"))
    return items.withColumn("normalized_text", norm).withColumn("content_hash", F.sha2("normalized_text", 256)).withColumn("logical_key", F.col("semantic_key"))
