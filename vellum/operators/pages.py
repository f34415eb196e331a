"""Pages of a large table at any depth: sorted ranges in folders of their own, and a directory of their sizes.

OFFSET sorts all rows and throws most of them away.  Here the table is sorted once by ranges; the directory
tells how many rows lie before each range, so a page reads the one or two ranges that hold it, wherever it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
SIZE = 500_000


def write(items: DataFrame, path: str, size: int = SIZE) -> None:
    """Write items below path in book, chapter and sequence order, with their directory."""
    order = [F.asc_nulls_first("book_code"), F.asc_nulls_first("chapter"), F.asc("sequence_no"), F.asc("id")]
    parts = max(1, -(-items.count() // size))
    ranged = items.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits number the range, the lower 33 the row in it
    at = ranged.withColumn("_at", F.monotonically_increasing_id())
    rows = at.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")).drop("_at")
    rows.write.partitionBy("_part").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/columns")  # a table without rows has no folder to tell them
    sizes = items.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    # one row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).write.parquet(f"{path}/directory")


def page(spark: SparkSession, path: str, limit: int = 300, offset: int = 0) -> DataFrame:
    """The items of one page in order, with their place from 0; reads only the ranges that hold the page."""
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000 and offset not negative")
    directory = spark.read.parquet(f"{path}/directory")
    held = directory.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()  # ranges of one page
    columns = spark.read.parquet(f"{path}/columns").schema
    if not held:
        return spark.createDataFrame([], columns).withColumn("place", F.lit(0).cast("long")).drop("_part", "_nth")
    # their folders alone are listed
    rows = spark.read.schema(columns).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/_part={r['part']}" for r in held])
    before = F.create_map(*[F.lit(x) for r in held for x in (r["part"], r["before"])])
    placed = rows.withColumn("place", before[F.col("_part")] + F.col("_nth"))
    return placed.filter((F.col("place") >= offset) & (F.col("place") < offset + limit)).drop("_part", "_nth").orderBy("place")
