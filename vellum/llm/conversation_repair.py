"""Repair of the structure of conversations: cost-to-go by dynamic programming, then a greedy walk.

A conversation's rows, in the order of their turns, become a sequence of roles `(s?(ua)+)?` (by initials:
an optional system row, then user and assistant in turn, or nothing) by the cheapest edits: Keep 0,
Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant row 5; a truncated row that is
not deleted adds 5, blank and duplicate rows must be deleted.

The grammar has four states.  Backwards over the rows, each state gets the least cost to the end; then a
walk from the first row takes, among the edits that keep to that cost, the one whose initial is least in
ASCII (Delete, Insert, Keep, Rerole).  An edit's initial and the state give the next state, so the walk
finds the least audit string.

Rows are sorted over the whole table by ranges and cut into segments of bounded size, so that a
conversation of any length is shared by many tasks.  A conversation that lies in one segment is solved
there.  For the others each segment becomes a 4 by 4 matrix of costs between the states at its two ends;
the matrices are multiplied backwards, the segments' walks from each state are chained forwards, and every
segment then writes its part.  Only these matrices, and the final hash, which is sequential by nature, pass
one conversation through one task, as a sorted stream that keeps one row at a time.

Cases: null roles and texts count as one space; rows without a turn come first; rows of one turn are taken
by role, then text, and equal ones are merged with their number before they are shuffled; a role whose
initial the grammar lacks can be deleted or reroled only; a null conv_id is a conversation of its own; a
conversation without rows needs no edit; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fingerprint, shuffle_partitions, stored

#: Bounds of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = 1, 2, 3
NEVER = 1 << 60
#: States: nothing yet, after system, after user, after assistant.  Where Insert and Rerole lead, and the role they give.
STEP, GIVEN = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Where a kept row leads, by its role's initial; -1: nowhere.
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_NOWHERE = (-1, -1, -1, -1)
_LEGAL = {"su", "ua", "au"}


def relaxed(cost: list[int]) -> list[int]:
    """Costs once Insert may come first."""
    c2, c3 = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + c2), min(cost[1], INSERT + c2), c2, c3]


#: Costs behind the last row.
END = relaxed([0, NEVER, NEVER, 0])


def cost_to_go(rows: list[dict], end: list[int]) -> list[list[int]]:
    """The least cost from each state before each row, and behind the last: `end`."""
    costs = [end]
    for row in reversed(rows):
        after, more, fault = costs[-1], DELETE * (row["times"] - 1), row["fault"]
        base = [DELETE + x for x in after]
        if fault not in (BLANK_ROW, DUPLICATE_ROW):
            left = TRUNCATED if fault == TRUNCATED_ROW else 0
            kept = KEPT.get(row["role"][:1], _NOWHERE)
            base = [min(base[s], left + REROLE + after[STEP[s]], left + KEEP + after[kept[s]] if kept[s] >= 0 else NEVER) for s in range(4)]
        costs.append(relaxed([min(more + x, NEVER) for x in base]))
    return costs[::-1]


def walk(rows: list[dict], costs: list[list[int]], state: int, last: bool, out: list | None = None) -> tuple[int, str]:
    """The state behind the rows and the audit; out gets (role, text) of the repaired rows.  last: the conversation ends here."""
    audit = []
    out = [] if out is None else out

    def insert(i: int, state: int) -> int:
        audit.append("I")
        out.append((GIVEN[state], ""))
        return STEP[state]

    for i, row in enumerate(rows):
        after, more, fault = costs[i + 1], DELETE * (row["times"] - 1), row["fault"]
        left = more + (TRUNCATED if fault == TRUNCATED_ROW else 0)
        while costs[i][state] != more + DELETE + after[state] and costs[i][state] == INSERT + costs[i][STEP[state]]:
            state = insert(i, state)
        kept = KEPT.get(row["role"][:1], _NOWHERE)[state]
        if costs[i][state] == more + DELETE + after[state]:
            audit.append("D")
        elif kept >= 0 and costs[i][state] == left + KEEP + after[kept]:
            audit.append("K")
            out.append((row["role"], row["text"]))
            state = kept
        else:
            audit.append("R")
            out.append((GIVEN[state], row["text"]))
            state = STEP[state]
        audit.append("D" * (row["times"] - 1))
    while last and costs[-1][state]:
        state = insert(len(rows), state)
    return state, "".join(audit)


def segment_matrix(rows: list[dict]) -> list[int]:
    """Least cost from each state (row) before the rows to each state (column) behind them."""
    columns = [cost_to_go(rows, [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def summary(rows: list[dict]) -> dict:
    """What is counted of a segment; first and last row for the pair and the turn that two segments share."""
    n = {k: sum(r["times"] for r in rows if r["fault"] == k) for k in (BLANK_ROW, DUPLICATE_ROW)}
    copies = sum(r["times"] - 1 for r in rows)
    extra = sum(r["times"] - 1 for r in rows if r["fault"] not in (BLANK_ROW, DUPLICATE_ROW))  # copies of a row that is not blank are duplicates
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "blank": n[BLANK_ROW], "duplicate": n[DUPLICATE_ROW] + extra, "truncated": sum(r["fault"] == TRUNCATED_ROW for r in rows),
        "illegal": copies + sum(a["role"][:1] + b["role"][:1] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False)), "turns": len(set(turns)),
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "head": rows[0]["role"][:1], "tail": rows[-1]["role"][:1],
    }


def joined(a: dict, b: dict) -> dict:
    """The summary of two adjacent segments."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    shared = a["high"] is not None and a["high"] == b["low"]
    return out | {
        "illegal": a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in _LEGAL), "turns": a["turns"] + b["turns"] - shared,
        "low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"], "head": a["head"], "tail": b["tail"],
    }


def counted(s: dict) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"gaps": gaps} | {k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}


KEYS = ["none", "conv"]
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("fault", pa.int32())])
_TOLD = pa.struct([("role", pa.string()), ("text", pa.string())])
_PLACE = [("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_SUMMARY = [(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")] + [("head", pa.string()), ("tail", pa.string())]
_NAMES = {pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(_ROW): "array<struct<turn: long, role: string, text: string, times: long, fault: int>>", pa.list_(_TOLD): "array<struct<role: string, text: string>>"}


def _mapped(df: DataFrame, make, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """mapInArrow with make(iterator of rows) -> iterator of rows as dicts, one batch of rows at a time."""
    schema = pa.schema(fields)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                yield from batch.slice(i, 16).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in make(rows_of(batches)):
            held.append(row)
            size += 1 + sum(map(len, (v for v in row.values() if isinstance(v, (list, str)))))
            if size > SEGMENT_ROWS * 4:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, ", ".join(f"{n} {_NAMES[kind]}" for n, kind in fields))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """none, conv, turn, role, text, times, fault, sorted over the whole table; equal rows merged."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    conv = F.col("conv_id").cast("long")
    plain = rows.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    runs = plain.groupBy(*KEYS, "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("f", fingerprint("text"))
    at = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    again = runs.groupBy(*KEYS, "role", "f").agg(F.min(at).alias("first"), F.count("*").alias("places")).filter("places > 1").drop("places")
    held = runs.join(again, [*KEYS, "role", "f"], "left")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK_ROW).when(F.col("first").isNotNull() & (at != F.col("first")), DUPLICATE_ROW).when(~ends, TRUNCATED_ROW).otherwise(0)
    order = [*KEYS, F.col("turn").asc_nulls_first(), "role", "text"]
    out = held.select(*KEYS, "turn", "role", "text", "times", fault.alias("fault"))
    return out.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def segments(rows: DataFrame) -> DataFrame:
    """none, conv, part, nth, whole, rows: pieces of conversations in order of (part, nth); whole: the only piece."""

    def cut(stream: Iterator[dict]) -> Iterator[dict]:
        part, nth, waiting = TaskContext.get().partitionId(), 0, None
        first = True
        for key, own in groupby(stream, lambda r: (r["none"], r["conv"])):
            if waiting:  # not the last conversation of the partition
                yield waiting
            held, chars, pieces = [], 0, 0
            edge, first = first, False  # the first one may have begun in the partition before
            for row in own:
                if held and (len(held) >= SEGMENT_ROWS or chars > SEGMENT_CHARS):
                    yield dict(zip(("none", "conv", "part", "nth", "whole", "rows"), (*key, part, nth, False, held), strict=True))
                    held, chars, pieces, nth = [], 0, pieces + 1, nth + 1
                held.append({k: row[k] for k in ("turn", "role", "text", "times", "fault")})
                chars += len(row["text"])
            waiting = dict(zip(("none", "conv", "part", "nth", "whole", "rows"), (*key, part, nth, not edge and not pieces, held), strict=True))
            nth += 1
        if waiting:
            yield waiting | {"whole": False}  # it may go on in the next partition

    return stored(_mapped(sorted_rows(rows), cut, [*_PLACE, ("whole", pa.bool_()), ("rows", pa.list_(_ROW))]))


def _solved(stream: Iterator[dict]) -> Iterator[dict]:
    for x in stream:
        costs, out = cost_to_go(x["rows"], END), []
        audit = walk(x["rows"], costs, 0, True, out)[1]
        yield {k: x[k] for k in ("none", "conv", "part", "nth")} | counted(summary(x["rows"])) | {"cost": costs[0][0], "audit": audit, "told": [{"role": r, "text": t} for r, t in out]}


def _ends(stream: Iterator[dict]) -> Iterator[dict]:
    """From the last segment of a conversation to the first: the costs behind each."""
    for _, own in groupby(stream, lambda r: (r["none"], r["conv"])):
        end, last = END, True
        for x in own:
            yield {"part": x["part"], "nth": x["nth"], "end": end, "last": last}
            m, last = x["matrix"], False
            end = [min(min(m[4 * s + t] + end[t] for t in range(4)), NEVER) for s in range(4)]


def _starts(stream: Iterator[dict]) -> Iterator[dict]:
    """From the first segment to the last: the state before each; the last one has the conversation's counts."""
    for _, own in groupby(stream, lambda r: (r["none"], r["conv"])):
        state, total, cost = 0, None, None
        for x in own:
            total = joined(total, x) if total else {k: x[k] for k, _ in _SUMMARY}
            cost = x["cost"] if cost is None else cost
            yield {"part": x["part"], "nth": x["nth"], "state": state} | (counted(total) | {"cost": cost} if x["last"] else {})
            state = x["next"][state]


_RESULT = [*_PLACE, *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("told", pa.list_(_TOLD))]


def repaired_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations in one piece, and of pieces of the others: none, conv, part, nth, counts (of a
    conversation, in its last piece only), audit and told (the repaired rows, each with role and text)."""
    pieces = segments(rows)
    whole, parts = pieces.filter("whole"), pieces.filter("NOT whole")

    def states(stream: Iterator[dict]) -> Iterator[dict]:
        for x in stream:
            yield {k: x[k] for k in ("none", "conv", "part", "nth")} | {"matrix": segment_matrix(x["rows"])}

    def chained(stream: Iterator[dict]) -> Iterator[dict]:
        for x in stream:
            costs = cost_to_go(x["rows"], x["end"])
            # what cannot be reached has no walk
            then = [walk(x["rows"], costs, s, False)[0] if costs[0][s] < NEVER else 0 for s in range(4)]
            yield {k: x[k] for k in ("none", "conv", "part", "nth", "last")} | summary(x["rows"]) | {"cost": costs[0][0], "next": then}

    def written(stream: Iterator[dict]) -> Iterator[dict]:
        for x in stream:
            out: list = []
            audit = walk(x["rows"], cost_to_go(x["rows"], x["end"]), x["state"], x["last"], out)[1]
            yield {k: x[k] for k, _ in _RESULT[:-2]} | {"audit": audit, "told": [{"role": r, "text": t} for r, t in out]}

    dealt = shuffle_partitions(rows.sparkSession)
    matrices = _mapped(parts.select("none", "conv", "part", "nth", "rows"), states, [*_PLACE, ("matrix", pa.list_(pa.int64()))])
    backwards = matrices.repartition(dealt, *KEYS).sortWithinPartitions(*KEYS, F.desc("part"), F.desc("nth"))
    ends = stored(_mapped(backwards, _ends, [("part", pa.int64()), ("nth", pa.int64()), ("end", pa.list_(pa.int64())), ("last", pa.bool_())]))
    ended = parts.join(ends, ["part", "nth"])
    links = _mapped(ended.select("none", "conv", "part", "nth", "last", "rows", "end"), chained, [*_PLACE, ("last", pa.bool_()), *_SUMMARY, ("cost", pa.int64()), ("next", pa.list_(pa.int64()))])
    forwards = links.repartition(dealt, *KEYS).sortWithinPartitions(*KEYS, "part", "nth")
    begun = stored(_mapped(forwards, _starts, [("part", pa.int64()), ("nth", pa.int64()), ("state", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64())]))
    return _mapped(whole.select("none", "conv", "part", "nth", "rows"), _solved, _RESULT), _mapped(ended.join(begun, ["part", "nth"]), written, _RESULT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, part, nth, place (their order), role and text of the repaired conversations."""
    whole, parts = repaired_segments(rows)
    each = whole.union(parts).select("none", "conv", "part", "nth", F.posexplode("told").alias("place", "row"))
    return each.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "part", "nth", "place", "row.role", "row.text")


_DIGEST = [*_PLACE[:2], *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _hashed(stream: Iterator[dict]) -> Iterator[dict]:
    for key, own in groupby(stream, lambda r: (r["none"], r["conv"])):
        sha, audit, between, x = hashlib.sha256(), [], "", {}
        for x in own:
            for row in x["told"]:
                sha.update(f"{between}{row['role']}:{row['text']}".encode())
                between = "\n"
            audit.append(x["audit"])
        yield dict(zip(KEYS, key, strict=True)) | {c: x[c] for c in (*_COUNTS, "cost")} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}


def repair_digests(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows."""
    whole, parts = repaired_segments(rows)
    ordered = parts.repartition(shuffle_partitions(rows.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "part", "nth")
    out = _mapped(whole, _hashed, _DIGEST).union(_mapped(ordered, _hashed, _DIGEST))
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *[c for c, _ in _DIGEST[2:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """repair_digests of the damaged rows, for every conv_id of conversations."""
    found = repair_digests(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (*_COUNTS, "cost")}
    return out.withColumns(numbers | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
