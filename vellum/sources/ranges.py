"""Large text files as ordered pieces over many tasks, and prefix scans over one summary row a range.

A piece is the text up to a separator, a range a bounded number of successive pieces; (file, range, nth)
is their order, nth counts from 0 in each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of a range where the content is a cell; files of up to RANGE_CHARS characters are read in one go.
RANGE_PIECES, RANGE_CHARS = 8192, 1 << 20
RANGE = ["file", "range"]


def text_of(content: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.col(content).cast("string")).alias(content)


def read_pieces(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, range, nth, piece of files of any size: a range is what Spark's reader takes for one split.

    Further columns, octets (of the piece and its separator) and file_size: as the reader leaves out a
    separator that ends the file, only their sums tell whether there is one.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("order"), F.make_valid_utf8("value").alias("piece"), (F.octet_length("value") + len(separator.encode())).alias("octets"), F.col("_metadata.file_size").alias("file_size"))
    nth = F.row_number().over(Window.partitionBy(*RANGE).orderBy("order")) - 1
    return _without_mark(rows.withColumn("nth", nth.cast("long"))).select(*RANGE, "nth", "piece", "octets", "file_size")


def pieces_of(files: DataFrame, separator: str = "\n", size: int = RANGE_PIECES) -> DataFrame:
    """The same of files (file, content as text)."""
    rows = files.select("file", F.posexplode(F.split("content", f"\\Q{separator}\\E")).alias("at", "piece"))
    return _without_mark(rows.select("file", F.floor(F.col("at") / size).alias("range"), (F.col("at") % size).cast("long").alias("nth"), "piece"))


def _without_mark(rows: DataFrame) -> DataFrame:
    """A byte-order mark before the first piece is none of the text."""
    first = (F.col("range") == 0) & (F.col("nth") == 0)
    return rows.withColumn("piece", F.when(first, F.regexp_replace("piece", "^\ufeff", "")).otherwise(F.col("piece"))).drop("order", "at")


def earlier(column: str | Column) -> Column:
    """The last value of a summary's column in earlier ranges of the file."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))


def summed_before(column: str | Column, *scope: str) -> Column:
    """The sum of a summary's column over earlier ranges of the file, or of a scope in it."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("file", *scope).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (file, range, ..) with `number`: their place in the file from 0, by range and then by order."""
    within = Window.partitionBy(*RANGE)
    rows = rows.withColumns({"_nth": F.row_number().over(within.orderBy(*order)), "_n": F.count("*").over(within)})
    before = rows.filter("_nth = 1").select(*RANGE, summed_before("_n").alias("_before"))
    return rows.join(before, RANGE).withColumn("number", F.col("_before") + F.col("_nth") - 1).drop("_nth", "_n", "_before")


def running(column: str | Column) -> Column:
    """The sum of a column over the range up to and with a piece."""
    return F.sum(column).over(Window.partitionBy(*RANGE).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))


def with_sum_before(pieces: DataFrame, column: str, name: str) -> DataFrame:
    """pieces with `name`: the sum of a column over all earlier pieces of the file."""
    before = pieces.groupBy(*RANGE).agg(F.sum(column).alias("n")).select(*RANGE, summed_before("n").alias("_before"))
    return pieces.join(before, RANGE).withColumn(name, F.col("_before") + running(column) - F.col(column)).drop("_before")


def stretches(pieces: DataFrame, separator: str) -> DataFrame:
    """file, range, nth, text of the stretches that begin at `fresh` pieces, `alone` ones (nearly all) without a shuffle."""
    begun = pieces.groupBy(*RANGE).agg(F.max(F.when(F.col("fresh"), F.col("nth"))).alias("last")).select(*RANGE, earlier(F.when(F.col("last").isNotNull(), F.struct("range", F.col("last").alias("nth")))).alias("carried"))
    own = F.last(F.when(F.col("fresh"), F.struct("range", "nth")), ignorenulls=True).over(Window.partitionBy(*RANGE).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    # what is not fresh belongs to the last fresh piece, perhaps in an earlier range
    parts = pieces.withColumn("own", own).filter("NOT alone").join(begun, RANGE).withColumn("at", F.coalesce("own", "carried"))
    joined = parts.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("range", "nth", "piece"))).alias("pieces"))
    joined = joined.select("file", "at.range", "at.nth", F.array_join(F.transform("pieces", lambda x: x["piece"]), separator).alias("text"))
    return pieces.filter("alone").select(*RANGE, "nth", F.col("piece").alias("text")).union(joined)
