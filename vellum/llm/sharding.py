"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in one global order by range partitioning: by the fingerprint of the text, then doc_id,
so equal texts stand side by side and a very large group of them is spread over many partitions.
Every partition reports one total; a running sum over these few totals gives each partition its
start offset, and a streaming pass adds the offsets inside the partition.  The byte axis is then cut
at equal targets.

A cut that falls into a group of equal texts moves to the group's nearer end, if the group is no
larger than a hundredth of a shard or than the largest document; a larger group is cut between two
documents, as the shards' sizes would differ by more otherwise.  At most n_shards - 1 groups are cut.

Cases: a null text has size 1 and forms no group with the empty text; a null doc_id sorts first in
its group; repeated rows each get a place of their own; an empty table gives an empty result; further
columns of the input are ignored (kept by `write_shards`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import durable, id_text, shuffle_partitions, typed_id, whole

_OUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
_GROUP = ["grp", "crc", "size", "none"]


def _keyed(text: str, doc_id: str) -> list[Column]:
    known = F.coalesce(F.col(text), F.lit(""))
    return [
        F.xxhash64(known).alias("grp"),
        F.crc32(known.cast("binary")).alias("crc"),
        (F.octet_length(known).cast("long") + 1).alias("size"),
        F.col(text).isNull().alias("none"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("tie"),
    ]


def _literal(df: DataFrame, row, names: list[str]) -> Column:
    """The values of a row as a struct of df's types."""
    types = {f.name: f.dataType for f in df.schema}
    return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in names])


def _located(docs: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Rows with the bytes and rows before each (begin, index); all bytes, all rows, the largest size."""
    rows = docs.select(*_keyed("text", "doc_id"))
    order = [*_GROUP, "doc_id", "tie"]
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    ranged = durable(ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order))
    offsets, at, seen, largest = {}, 0, 0, 0
    for part, size, n, most in sorted(ranged.groupBy("part").agg(F.sum("size"), F.count("*"), F.max("size")).collect()):
        offsets[part] = (at, seen)
        at, seen, largest = at + size, seen + n, max(largest, most)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = None
        for pdf in batches:
            if len(pdf):
                if begin is None:
                    begin, index = offsets[int(pdf["part"].iloc[0])]
                size = pdf["size"].to_numpy(np.int64)
                ends = begin + np.cumsum(size)
                yield pdf.drop(columns=["part", "tie"]).assign(begin=ends - size, index=index + np.arange(len(pdf)))
                begin, index = int(ends[-1]), index + len(pdf)

    schema = "grp long, crc long, size long, none boolean, doc_id string, begin long, index long"
    return durable(typed_id(ranged.withColumn("doc_id", id_text()).mapInPandas(locate, schema))), at, seen, largest


def _cuts(located: DataFrame, total: int, largest: int, n_shards: int) -> list[tuple[int, int]]:
    """For each shard but the first: the bytes and the rows before it.  A few rows reach the driver."""
    targets = [total * k // n_shards for k in range(1, n_shards)]
    hit = [(F.col("begin") <= t) & (F.col("begin") + F.col("size") > t) for t in targets]
    found = located.filter(F.exists(F.array(*hit), lambda x: x)).collect() if targets else []
    if not found:
        return []
    same = F.exists(F.array(*[F.struct(*_GROUP) == _literal(located, r, _GROUP) for r in found]), lambda x: x)
    edges = located.filter(same).groupBy(*_GROUP).agg(F.min("begin").alias("lo"), F.max(F.col("begin") + F.col("size")).alias("hi"), F.min("index").alias("first"), (F.max("index") + 1).alias("end"))
    groups = {tuple(e[c] for c in _GROUP): e for e in edges.collect()}
    cuts = []
    for t in targets:
        r = next(r for r in found if r["begin"] <= t < r["begin"] + r["size"])
        e = groups[tuple(r[c] for c in _GROUP)]
        if e["hi"] - e["lo"] <= max(largest, total // (100 * n_shards)):
            ends = ((e["lo"], e["first"]), (e["hi"], e["end"]))
        else:
            ends = ((r["begin"], r["index"]), (r["begin"] + r["size"], r["index"] + 1))
        cuts.append(min(ends, key=lambda x: abs(x[0] - t)))
    return cuts


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    located, total, n, largest = _located(docs)
    if not n:
        return docs.sparkSession.createDataFrame([], _OUT)
    cuts = _cuts(located, total, largest, n_shards)
    shard = sum(((F.col("begin") >= at).cast("int") for at, _ in cuts), F.lit(0))
    first = F.array(*map(F.lit, [0, *[before for _, before in cuts]]))
    return located.withColumn("shard", shard).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("index") - first[F.col("shard")]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, files: int = 0) -> str:
    """Write whole documents as one folder per shard; the name of the folders' column, `shard` if docs has none.

    The order of shard_by_bytes is total but for rows that are equal, so the rows at the cuts tell the
    shard of every document, without a join.  `files`: range partitions over all shards.
    """
    located, total, n, largest = _located(docs)
    name = next(x for k in range(len(docs.columns) + 1) if (x := "shard" + f"_{k}" * bool(k)) not in docs.columns)
    cuts = _cuts(located, total, largest, n_shards) if n else []
    found = {r["index"]: r for r in located.filter(F.col("index").isin([i for _, i in cuts])).collect()} if cuts else {}
    order = [*_GROUP, "doc_id"]
    rows = docs.select(*_keyed("text", "doc_id"), whole(docs).alias("doc"))
    after = [F.struct(*order) >= _literal(rows, found[i], order) for _, i in cuts if i in found]
    rows = rows.withColumn("at", sum((a.cast("int") for a in after), F.lit(0)))
    ranged = rows.repartitionByRange(max(files or shuffle_partitions(docs.sparkSession), n_shards), "at", *order, "tie").sortWithinPartitions("at", *order)
    ranged.select("doc.*", F.col("at").alias(name)).write.partitionBy(name).parquet(path)
    return name
