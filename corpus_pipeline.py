"""Corpus preparation in five stages: toxicity, line dedup, near-copy join, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what a stage
returns is written as Parquet and read again as the next one's docs.  The first four return the
columns of `documents` (further columns are carried along), the last one the encoding digests.

Cases: an empty table passes through all stages; a null text is clean, has no line, no shingle and
no passage, and is encoded as the empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontamination, jaccard_join, line_dedup, pieces, toxicity
from vellum.llm.common import table, work_folder
from vellum.llm.queries import model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the classifier learns from the training fold of docs."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line holds; documents of which nothing is left go."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more."""
    return jaccard_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return pieces.encoding_digests(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL cannot express the trained classifier, the chosen paths and the encoder; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents; intermediate tables lie in the shared folder until Python ends."""
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
