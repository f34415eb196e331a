"""Bilingual pairing: one row for each semantic key, with its source and its target record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(role: str, columns: list[str], order: Column) -> Column:
    return F.max_by(F.when(F.col("language_role") == role, F.struct(*columns)), F.when(F.col("language_role") == role, order)).alias(role)


def pivot(items: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """key, source, target (structs of columns, null where missing; the last record wins), n.

    One aggregation: both sides are picked in the same pass, with partial results on the map side.
    """
    order = F.struct("book_code", "chapter", "sequence_no", "id") if order is None else order
    return items.groupBy(F.coalesce(F.nullif("semantic_key", F.lit("")), "logical_key").alias("key")).agg(
        _side("source", columns, order), _side("target", columns, order), F.count("*").alias("n")
    )


def one_sided(pairs: DataFrame) -> DataFrame:
    """Keys with a record on exactly one side, and which."""
    side = F.when(F.col("source").isNotNull(), "source_only").otherwise("target_only")
    return pairs.filter(F.col("source").isNull() != F.col("target").isNull()).withColumn("side", side)


def list_pairs(items: DataFrame, columns: list[str], limit: int = 250, **equal) -> DataFrame:
    """A page of pairs in chapter order: limit the keys first, then fetch their records.

    equal: filters of the first phase by column (None: no filter); the second phase takes all
    records of the keys, as a pair may reach outside the filter.
    """
    if not 0 < limit <= 2500:
        raise ValueError("limit must be from 1 to 2500")
    chosen = items
    for name, value in equal.items():
        chosen = chosen if value is None else chosen.filter(F.col(name) == value)
    keys = chosen.groupBy("semantic_key").agg(F.min("chapter").alias("first_chapter"), F.min("sequence_no").alias("first_seq"))
    keys = keys.orderBy("first_chapter", "first_seq", "semantic_key").limit(limit)
    pairs = pivot(items.join(keys.select("semantic_key"), "semantic_key", "left_semi"), columns)
    return pairs.join(keys.withColumnRenamed("semantic_key", "key"), "key").orderBy("first_chapter", "first_seq", "key")
