"""N-gram Jaccard self-join of documents by chosen paths.

A document is its set of five-word shingles.  Sets are split recursively: at every node of a random
tree a set of n shingles goes on with each shingle whose hash at that node is below 1/(0.8 n), into
one child for each.  Two sets of similarity 0.8 share one child or more on average at every level,
dissimilar ones almost never share a path.  Sets on one path after `depth` levels form a bucket,
which is compared by brute force and exactly; runs with new hashes repeat until the recall at the
threshold reaches the target.

Equal sets are one class, and a class walks the tree once.  Buckets with the same members are
compared once, and a bucket whose members earlier buckets have joined is not compared again.  A bucket of more than `block` sets is cut into blocks and every pair of blocks is a
task of its own, so no task holds more than two blocks.  A task reports a spanning forest of its
links; distributed union-find joins these.  Links are then counted inside each component, again in
pairs of blocks: all links lie inside components, so none is lost, and pairs are never written out.

Cases: null and empty texts and texts without a word have no shingles, link to nothing and are
groups of their own; texts of one to four words are one shingle; equal texts are linked; repeated
rows count as separate documents; a null doc_id takes part, and names a group only if it has no
other; an empty table gives an empty result.  Rows are followed by a 128-bit fingerprint of
(doc_id, text), sets by a 64-bit fingerprint of their shingles: n different sets meet by chance with
a probability of n * n / 2^65, which is 0.003 for 3e8.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import durable, fingerprint, id_text, shuffle_partitions, typed_id, whole
from vellum.llm.components import connected_components

SHINGLE = 5
_WORD = re.compile(r"\w+")
_M1, _M2, _S1, _S2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S1)
    x *= _M1
    x ^= x >> _S2
    x *= _M2
    x ^= x >> _S1
    return x


class Shingles:
    """The sorted fingerprints of a text's five-word shingles; a bounded table of word hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _word(self, w: str) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get = self.known.get
        w = np.array([get(x) or self._word(x) for x in words], np.uint64)
        h, k = w[: max(1, len(w) - SHINGLE + 1)], min(SHINGLE, len(w))
        for i in range(1, k):
            h = _mix(h) + w[i : len(w) - k + 1 + i]
        return np.unique(_mix(h + np.uint64(k)))


def runs_needed(depth: int, recall: float) -> int:
    """Runs until two sets at the threshold have met with probability `recall`."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def paths(s: np.ndarray, runs: int, depth: int, similarity: float) -> list[int]:
    """The nodes that a set reaches at the given depth, over all runs."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(s)))))
    nodes = _mix(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(20))
    for _ in range(depth):
        found = []
        for node in nodes:
            h = _mix(s ^ node)
            found.append(h[h <= limit])
        nodes = _mix(np.concatenate(found) + np.uint64(1)) if found else nodes
    return np.unique(nodes).view(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the shingles that two sets or more hold."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[col] > 1
    new = np.cumsum(n > 1) - 1
    row, col, width = row[keep], new[col[keep]], int((n > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    step = 8192
    for at in range(0, width, step):
        lo, hi = np.searchsorted(col, [at, at + step])
        dense = np.zeros((len(sets), min(step, width - at)), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        out += dense @ dense.T
    size = np.array([len(s) for s in sets], float)
    np.fill_diagonal(out, size)
    return out


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets have at least the given Jaccard similarity."""
    both = overlaps(sets)
    size = np.diag(both)
    return both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9


def forest(links: np.ndarray) -> np.ndarray:
    """For each set the smallest position it is connected with."""
    root = np.arange(len(links))
    while True:
        new = np.where(links, root[None, :], len(links)).min(axis=1)
        new = np.minimum(root, new)
        if (new == root).all():
            return root
        root = new


def _row(docs: DataFrame) -> Column:
    both = fingerprint("doc_id", "text")
    return F.concat_ws("-", F.hex(both["a"]), F.hex(both["b"]))


def _blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows dealt to pairs (i, j) of the blocks of their group; `own` is the row's block."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _grouped(batches: Iterator[pd.DataFrame], group: str) -> Iterator[pd.DataFrame]:
    """The groups of a sorted stream, one at a time."""
    kept = None
    for pdf in batches:
        pdf = pd.concat([kept, pdf], ignore_index=True) if kept is not None else pdf
        if not len(pdf):
            continue
        key = pdf[[group, "i", "j"]].to_numpy()
        starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pdf.iloc[a:b]
        kept = pdf.iloc[starts[-1] :]
    if kept is not None and len(kept):
        yield kept


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]


def similar_documents(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, depth: int = 3, block: int = 512, waves: int = 4) -> tuple[DataFrame, DataFrame]:
    """Keyed rows (row, doc_id, cls, n) and classes (cls, root, root_doc, root_row, links, copies)."""
    runs = runs_needed(depth, recall)
    keyed = docs.select(_row(docs).alias("row"), id_text(), "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingles()
        for pdf in batches:
            sets = [of(t) for t in pdf["text"]]
            cls = pd.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], dtype="Int64")
            # a class walks once, however many copies the batch holds
            seen, keys = set(), []
            for c, s in zip(cls, sets, strict=True):
                keys.append(paths(s, runs, depth, similarity) if len(s) and c not in seen else None)
                seen.add(c)
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "cls": cls, "n": [len(s) for s in sets], "paths": keys})

    walked = durable(typed_id(keyed.mapInPandas(walk, "row string, doc_id string, cls long, n int, paths array<long>")))
    rows = walked.select("row", "doc_id", "cls", "n")
    classes = durable(
        rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("speaker"), F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    )
    # a class's paths are the same in all its copies: repeats fall together before the shuffle
    steps = walked.select("cls", F.explode("paths").alias("path")).distinct()
    buckets = (
        steps.groupBy("path")
        .agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
        .filter("size > 1")
        .groupBy("size", "x", "y")
        .agg(F.min("path").alias("path"))
        .select("path", "size")
    )
    members = durable(steps.join(buckets, "path").join(classes.select("cls", "speaker"), "cls").select("path", "size", "cls", "speaker"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingles()
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "shingles": [of(t).tobytes() for t in pdf["text"]]})

    speakers = members.select(F.col("speaker").alias("row"), "cls").distinct()
    texts = keyed.select("row", "text").join(speakers, "row", "left_semi").dropDuplicates(["row"])
    sets = durable(texts.mapInPandas(spell, "row string, shingles binary").join(speakers, "row").select("cls", "shingles"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, "path"):
            cls, root = pdf["cls"].to_numpy(np.int64), forest(linked(_sets(pdf), similarity))
            apart = root != np.arange(len(root))
            yield pd.DataFrame({"a": cls[apart], "b": cls[root[apart]]})

    def compared(some: DataFrame) -> DataFrame:
        rows = _blocks(some.select("path", "size", "cls"), "path", "size", block).join(sets, "cls")
        return durable(_dealt(rows, "path").mapInPandas(compare, "a long, b long"))

    # a part of the buckets first; what lies in one component then needs no comparison, as links are counted later
    early = F.pmod("path", F.lit(waves)) == 0
    edges = compared(members.filter(early))
    rooted = members.filter(~early).join(connected_components(edges), F.col("cls") == F.col("node"), "left").select("path", "size", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("path")
    edges = edges.union(compared(rooted.join(mixed, "path")))
    roots = connected_components(edges).withColumnRenamed("node", "cls")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    grouped = _blocks(roots.join(sizes, "root").join(classes.select("cls", "copies"), "cls"), "root", "size", block).join(sets, "cls")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, "root"):
            links = linked(_sets(pdf), similarity)
            np.fill_diagonal(links, False)
            if pdf["i"].iloc[0] != pdf["j"].iloc[0]:  # two blocks: only links across them
                own = pdf["own"].to_numpy()
                links &= own[:, None] != own[None, :]
            copies = pdf["copies"].to_numpy(np.int64)
            yield pd.DataFrame({"cls": pdf["cls"].to_numpy(np.int64), "texts": links.sum(axis=1), "links": links @ copies})

    counted = _dealt(grouped, "root").mapInPandas(count, "cls long, texts long, links long")
    counted = counted.groupBy("cls").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    whole = classes.join(roots, "cls", "left").join(counted, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = whole.groupBy("root").agg(F.min_by("first", F.struct(F.col("first.doc_id").isNull(), "first")).alias("head"))
    whole = whole.join(heads, "root").select(
        "cls", F.col("head.doc_id").alias("root_doc"), F.col("head.row").alias("root_row"), "copies", F.coalesce("texts", F.lit(0)).alias("texts"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return rows.select("row", "doc_id", "cls", "n"), whole


def join_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id (smallest doc_id linked to it, over any number of links), n_links (other documents
    of at least that similarity), n_text_links (other shingle sets among them), n_shingles; a row for every row of docs."""
    rows, whole = similar_documents(docs, similarity, recall)
    return rows.join(whole, "cls", "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("root_doc")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), F.col("n").alias("n_shingles")
    )


def keep_first(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, all columns as they are; documents without shingles stay."""
    rows, whole_ = similar_documents(docs, similarity, recall)
    named = docs.select(_row(docs).alias("row"), whole(docs).alias("doc"))
    heads = rows.filter("cls IS NOT NULL").join(whole_, "cls").filter("row = root_row").select("row", F.lit(True).alias("one")).distinct()
    blank = rows.filter("cls IS NULL").select("row", F.lit(False).alias("one")).distinct()
    stay = named.join(heads.unionByName(blank), "row")
    return stay.filter("one").dropDuplicates(["row"]).unionByName(stay.filter("NOT one")).select("doc.*")
