"""Import batches as one unit: staged under the state they were made for, published by one rename.

A project's tables lie in a folder with a subfolder for each published batch, numbered from 1, and the
state is all of them.  A batch is staged beside them: classified against the state it finds and written in
full, where nobody looks.  To publish is to rename the staged folder to the next number, which the file
system does at once or not at all; if another batch has taken that number, the rename fails and the batch is
refused, as it was made for a state that is no more.  So what is committed is what the preview showed, a job
that is killed at any point leaves the state as it was, and two commits never mix.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.operators import importing, scans

#: Tables of a batch.
TABLES = ("items", "conflicts", "resources", "books", "import_files", "batches", "classified")


class StaleBatch(RuntimeError):
    """The stored state has moved since the batch was staged."""


@dataclass(frozen=True)
class Staged:
    """A batch that is ready: the number of the last batch it has seen, and where it lies."""

    root: str
    base: int
    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table as it will be published; `classified` is what a preview shows."""
        return spark.read.parquet(f"{self.path}/{name}")


def _name(number: int) -> str:
    return f"batch-{number:012d}"


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def published(spark: SparkSession, root: str) -> int:
    """The number of the last published batch; 0 if there is none."""
    at = _at(spark, root)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    return max((int(n[6:]) for n in names if n.startswith("batch-")), default=0)


def read(spark: SparkSession, root: str, name: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """A table of the state after batch `upto` (default: the last)."""
    upto = published(spark, root) if upto is None else upto
    if not upto:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{_name(k)}/{name}" for k in range(1, upto + 1)])


def stage(root: str, files: DataFrame, incoming: DataFrame, created_at: int) -> Staged:
    """Classify and write a batch without touching the state.

    files: file_id, batch_id, filename, format, sha256, byte_size, language_code, resource_role.  incoming:
    canonical items with their file_id.  A file whose bytes are stored for its role and language is left out
    with all its items.  created_at orders batches in time.
    """
    spark = incoming.sparkSession
    base = published(spark, root)
    named = files.withColumn("created_at", F.lit(created_at).cast("long"))
    known = read(spark, root, "import_files", named.schema, base)
    lang = lambda df: F.coalesce(df["language_code"], F.lit(""))
    again = (named["sha256"] == known["sha256"]) & (named["resource_role"] == known["resource_role"]) & (lang(named) == lang(known))
    fresh = scans.kept(named.join(known, again, "left_anti"))
    rows = incoming.withColumn("created_at", F.lit(created_at).cast("long")).join(fresh.select("file_id"), "file_id", "left_semi")
    stored = read(spark, root, "items", rows.schema, base)
    sorted_out = scans.kept(importing.classify(rows, stored))
    inserted, conflicts = importing.commit(rows, stored, sorted_out)
    books = read(spark, root, "books", StructType().add("book_code", "string"), base)
    more = importing.committed(fresh, rows, stored, books, sorted_out)
    path = f"{root}/_staged/{uuid.uuid4().hex}"
    tables = {"items": inserted.select(*rows.columns), "conflicts": conflicts, "import_files": fresh, "classified": sorted_out} | more
    for name in TABLES:
        tables[name].write.parquet(f"{path}/{name}")
    return Staged(root, base, path)


def publish(spark: SparkSession, batch: Staged) -> int:
    """Make a staged batch part of the state; its number.  StaleBatch if the state has moved."""
    number = batch.base + 1
    jvm = spark.sparkContext._jvm
    source, target = _at(spark, batch.path), _at(spark, f"{batch.root}/{_name(number)}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if published(spark, batch.root) != batch.base:
        raise StaleBatch(f"batch {number} has been published by someone else")
    try:
        context.rename(source, target, options)  # never over a folder that is there
    except Exception as error:
        if published(spark, batch.root) != batch.base:
            raise StaleBatch(f"batch {number} has been published by someone else") from error
        raise
    return number


def preview(spark: SparkSession, batch: Staged) -> DataFrame:
    """One row: what the staged batch will do (see importing.summarize), its files and items."""
    counts = importing.summarize(batch.table(spark, "classified"))
    files = batch.table(spark, "import_files").agg(F.count("*").alias("new_files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    return counts.join(files)  # two tables of one row
