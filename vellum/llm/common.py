"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work: where it has fewer splits than there are cores (a single row group
    is one split), its rows are dealt to all of them first."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    A temporary folder is set only where none is named and all tasks run in this process (tests);
    on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='vellum-checkpoint-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_FOLDERS: dict[str, str] = {}  # by application


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        remove_folder(spark, path)


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below one of the application that goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/vellum-{app}"
        atexit.register(_remove_at_exit, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder."""
    path = work_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def bucketed(df: DataFrame, *columns: str) -> DataFrame:
    """Cut lineage like `stored`, with the rows in one bucket for each shuffle partition by columns, so that
    grouping by them and joins on them leave the rows where they are."""
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    name = f"vellum_{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.bucketBy(shuffle_partitions(spark), *columns).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._vellum_path = path
    atexit.register(_dropped_at_exit, spark, name)
    return out


def _dropped_at_exit(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` has written; nothing that is still to run may read them."""
    for t in tables:
        remove_folder(t.sparkSession, t._vellum_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fingerprint(*parts: Column | str) -> Column:
    """128 bits, so that different rows of a corpus of any size are told apart."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def id_text() -> Column:
    """doc_id as decimal text: pandas makes floats of a batch of numbers with a null."""
    return F.col("doc_id").cast("long").cast("string").alias("doc_id")


def typed_id(df: DataFrame) -> DataFrame:
    """df with doc_id, until now text, as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def drawn_below(wanted: int, count: int) -> int:
    """The highest of `wanted` in `count` equal parts of all 64-bit hashes: hash <= this draws about `wanted` of `count` rows."""
    return -(2**63) + min(2**64, wanted * 2**64 // max(count, 1)) - 1


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 3; remainder 1 is the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for the held-out fold; a null doc_id is never used for learning, so it is held out too."""
    return F.coalesce(fold(doc_id) == 1, F.lit(True))
