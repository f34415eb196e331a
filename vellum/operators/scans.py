"""Ordered scans whose groups may be larger than a task: sorted pieces, summaries that chain, pieces finished with their start state."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

#: Rows of a piece at most.
PIECE = 2048


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    A temporary folder is set only where none is named and all tasks run in this process (tests).
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


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def mapped(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow over rows as dicts; nothing but a few rows is held."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield from batch.slice(i, 64).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in make(rows(batches)):
            held.append(row)
            if len(held) >= 512:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(run, schema)


def pieces(rows: DataFrame, keys: list[str], order: list[str], size: int = PIECE) -> DataFrame:
    """keys, part, nth, whole, rows: the groups of keys, sorted by order and cut; (part, nth) is the order of pieces.

    The table is sorted by ranges, so that a large group lies in many tasks; whole: the group's only piece.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    inner = [f for f in rows.schema.fields if f.name not in keys]
    schema = StructType([rows.schema[k] for k in keys]).add("part", "long").add("nth", "long").add("whole", "boolean")
    schema = schema.add("rows", ArrayType(StructType(inner)))

    def cut(stream: Iterator[dict]) -> Iterator[dict]:
        part, nth, first, waiting = TaskContext.get().partitionId(), 0, True, None
        for key, own in groupby(stream, lambda r: tuple(r[k] for k in keys)):
            if waiting:
                yield waiting
            piece = lambda held, whole: dict(zip(keys, key, strict=True)) | {"part": part, "nth": nth, "whole": whole, "rows": held}  # noqa: B023, E731
            held, split = [], first  # the first group may have begun in the partition before
            for row in own:
                if len(held) >= size:
                    yield piece(held, False)
                    held, split, nth = [], True, nth + 1
                held.append({f.name: row[f.name] for f in inner})
            waiting, first, nth = piece(held, not split), False, nth + 1
        if waiting:
            yield waiting | {"whole": False}  # the group may go on in the next partition

    return kept(mapped(ranged, cut, schema))


def start_states(cut: DataFrame, keys: list[str], summarize: Callable[[list[dict]], object], advance: Callable[[object, object], object]) -> DataFrame:
    """part, nth, state (JSON; of the first piece: null) before each piece that is not whole.

    summarize gives a piece's effect, advance the state behind it from the state before it; both speak JSON.
    One task reads the summaries of a group, one for PIECE rows, as a sorted stream.
    """

    def effects(stream: Iterator[dict]) -> Iterator[dict]:
        for x in stream:
            yield {k: x[k] for k in (*keys, "part", "nth")} | {"effect": json.dumps(summarize(x["rows"]))}

    def chain(stream: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(stream, lambda r: tuple(r[k] for k in keys)):
            state = None
            for x in own:
                yield {"part": x["part"], "nth": x["nth"], "state": json.dumps(state)}
                state = advance(state, json.loads(x["effect"]))

    fields = StructType([cut.schema[k] for k in keys]).add("part", "long").add("nth", "long").add("effect", "string")
    told = mapped(cut.filter("NOT whole"), effects, fields)
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(told.repartition(n, *keys).sortWithinPartitions(*keys, "part", "nth"), chain, "part long, nth long, state string")


def finished(cut: DataFrame, states: DataFrame, finish: Callable[[list[dict], object], Iterator[dict]], schema: str) -> DataFrame:
    """What finish(rows, state before them) gives for every piece."""

    def run(stream: Iterator[dict]) -> Iterator[dict]:
        for x in stream:
            yield from finish(x["rows"], json.loads(x["state"]) if x["state"] else None)

    return mapped(cut.join(states, ["part", "nth"], "left").select("rows", F.col("state")), run, schema)
