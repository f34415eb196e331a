"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Every training text is read as overlapping passages of words; each passage is a query against an
inverted index of the test items.  An item's score is its BM25 score over the score of the item
with itself, so one threshold serves items of any length, and all items at or above it are
retrieved.  The index keeps the postings in blocks of items with the highest weight of each term in
each block.  An item's most common terms, as long as they stay below the threshold together with its
NEEDED - 1 heaviest other terms, are not essential; a passage with fewer than NEEDED of the item's
essential terms cannot reach the threshold (the WAND pivot).  A block for which no passage term
count gets there is never opened, and one whose block maxima add up to less than the threshold for
the passage's terms is skipped.

A retrieved item is verified exactly: it counts as leaked if the passage holds at least 0.8 of the
five-word shingles of both its question and its answer (the last sentence; the second half where an
item is one sentence).  A part of fewer than five words is one shingle.

Passages overlap by the words of the longest item and more, so that an item never falls between two.
Term statistics are counted once over the whole benchmark.  The index is shipped to the tasks in
slices of about `max_items` items; more items than that are dealt into several slices, which meet all
texts one after the other, so that the driver and a task hold one slice at a time.  Scores and results
are the same for any number of slices.

Cases: null and empty texts and items match nothing; items without a word are left out; repeated
items are reported under each item_id; a repeated doc_id is judged row by row; further columns are
kept by `keep_clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fingerprint, id_text, stored, typed_id, whole

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]+\s+")
SHINGLE = 5
NEEDED = 4


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item up to its last sentence, and of the last sentence."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    while ends and not words_of(text[ends[-1] :]):
        ends.pop()
    if ends and words_of(text[: ends[-1]]):
        return words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
    words = words_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


@dataclass
class Statistics:
    """Items with a word, their words in all, in how many items each word of interest occurs, and the words of the longest item."""

    items: int
    words: int
    df: dict[str, int]
    longest: int = 0


@dataclass
class Index:
    """Postings by term: blocks, their maxima, and the items' normed weights."""

    items: list[int]
    parts: list[tuple[set, set]]
    longest: int
    threshold: float
    block: int
    essential: dict[str, list[int]] = field(default_factory=dict)  # term -> blocks it is essential in
    highest: list[dict[str, float]] = field(default_factory=list)  # block -> term -> block maximum
    needed: list[int] = field(default_factory=list)  # block -> essential terms that a passage must have
    weights: list[dict[str, float]] = field(default_factory=list)  # item -> term -> weight over the item's own score

    @staticmethod
    def build(items: list[tuple[int, str]], statistics: Statistics | None = None, threshold: float = 0.5, block: int = 4, k1: float = 1.2, b: float = 0.75) -> Index:
        """statistics: those of the whole benchmark, of which items may be a slice; None: of the items."""
        items = [(i, t) for i, t in items if words_of(t)]
        words = [words_of(t) for _, t in items]
        counts = [Counter(ws) for ws in words]
        known = statistics or Statistics(len(items), sum(map(len, words)), Counter(w for c in counts for w in c), max(map(len, words), default=1))
        df, total, mean = known.df, known.items, known.words / max(known.items, 1)
        parts = [tuple(shingles(p) for p in question_and_answer(t)) for _, t in items]
        out = Index([i for i, _ in items], parts, max([known.longest, 1, *map(len, words)]), threshold, block)
        for ws, c in zip(words, counts, strict=True):
            raw = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(ws) / mean)) for w, n in c.items()}
            own = sum(raw.values())
            out.weights.append({w: x / own for w, x in raw.items()})
        for at in range(0, len(items), block):
            top: dict[str, float] = {}
            need = NEEDED
            for weight in out.weights[at : at + block]:
                heavy = sorted(weight.values(), reverse=True)
                m = next(m for m in range(NEEDED, 0, -1) if sum(heavy[: m - 1]) < threshold - 1e-9)
                need = min(need, m)
                rest, order = 0.0, sorted(weight, key=lambda w: (-df[w], w))  # the most common terms first
                for n, w in enumerate(order):
                    top[w] = max(top.get(w, 0.0), weight[w])
                    rest += weight[w]
                    if rest + sum(sorted((weight[x] for x in order[n + 1 :]), reverse=True)[: m - 1]) >= threshold - 1e-9:
                        blocks = out.essential.setdefault(w, [])
                        if at // block not in blocks:
                            blocks.append(at // block)
            out.highest.append(top)
            out.needed.append(need)
        return out

    def retrieve(self, terms: set[str], blocks: set[int]) -> Iterator[tuple[int, float]]:
        """Items of these blocks that score at least the threshold for a passage's terms, with their scores."""
        for k in blocks:
            top = self.highest[k]
            if sum([top[w] for w in top.keys() & terms]) < self.threshold - 1e-9:
                continue
            for i in range(k * self.block, min(len(self.items), (k + 1) * self.block)):
                weight = self.weights[i]
                score = sum([weight[w] for w in weight.keys() & terms])
                if score >= self.threshold - 1e-9:
                    yield i, score

    def retrieved(self, words: list[str]) -> Iterator[tuple[list[str], list[tuple[int, float]]]]:
        """The passages of a text that have items at or above the threshold, and these with their scores."""
        get = self.essential.get
        step = self.longest
        terms: dict[tuple[int, int], set[str]] = {}  # of a passage and a block; passage p: words p * step .. (p + 2) * step
        for i, w in enumerate(words):
            blocks = get(w)
            if blocks is not None:
                p = i // step
                for b in blocks:
                    terms.setdefault((p, b), set()).add(w)
                    terms.setdefault((p - 1, b), set()).add(w)
        passages: dict[int, set[int]] = {}
        for (p, b), ws in terms.items():
            if p >= 0 and len(ws) >= self.needed[b]:
                passages.setdefault(p, set()).add(b)
        for p, blocks in passages.items():
            passage = words[p * step : (p + 2) * step]
            got = list(self.retrieve(set(passage), blocks))
            if got:
                yield passage, got

    def leaks(self, text: str | None, overlap: float = 0.8) -> dict[int, tuple[float, float]]:
        """item_id -> best (score, overlap) of the passages in which the item is verified."""
        found: dict[int, tuple[float, float]] = {}
        for passage, got in self.retrieved(words_of(text)):
            have = [shingles_of(passage, n) for n in range(1, SHINGLE + 1)]
            for i, score in got:
                covered = min(_share(part, have) for part in self.parts[i] if part)
                if covered >= overlap:
                    best = found.get(self.items[i], (0.0, 0.0))
                    found[self.items[i]] = max(best, (score, covered))
        return found


def shingles_of(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _share(part: set, have: list[set]) -> float:
    """The share of a part's shingles (all of one length) that the passage holds."""
    n = len(next(iter(part)))
    return len(part & have[n - 1]) / len(part)


def build_indexes(benchmark: DataFrame, threshold: float = 0.5, max_items: int = 20_000) -> Iterator[Index]:
    """One index for each slice of about max_items items; only one slice is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL").distinct()

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [Counter(words_of(t)) for t in pdf["item"]]
            some = [k for k, w in enumerate(words) if w]
            yield pd.DataFrame({"item_id": pdf["item_id"].iloc[some].astype("Int64"), "item": pdf["item"].iloc[some], "n": [words[k].total() for k in some], "terms": [list(words[k]) for k in some]})

    spelled = stored(items.mapInPandas(terms, "item_id long, item string, n long, terms array<string>"))
    n, total, longest = spelled.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    slices = max(1, -(-n // max_items))
    cut = F.pmod(F.xxhash64("item_id", "item"), F.lit(slices)).alias("slice")
    each = spelled.select(cut, F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("slice").alias("slices"))
    df = stored(df) if slices > 1 else df
    for k in range(slices):
        part = spelled.filter(cut == k).select("item_id", "item").collect()
        known = df.filter(F.array_contains("slices", k)).select("term", "df").toLocalIterator()
        yield Index.build(sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])), Statistics(n, total, {r[0]: r[1] for r in known}, longest), threshold)


_FOUND = "items array<long>, best_score double, best_overlap double"


def _judged(texts: DataFrame, index: Index, overlap: float, keys: str, hits_only: bool) -> DataFrame:
    """keys (columns of texts but the text), items, best_score, best_overlap."""
    held = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for pdf in batches:
            found = [index.leaks(t, overlap) for t in pdf.pop("text")]
            pdf["items"] = [sorted(i for i in f if i is not None) for f in found]
            pdf["best_score"] = np.array([max((s for s, _ in f.values()), default=0.0) for f in found], float)
            pdf["best_overlap"] = np.array([max((o for _, o in f.values()), default=0.0) for f in found], float)
            yield pdf[pdf["best_overlap"] > 0] if hits_only else pdf

    return texts.mapInPandas(run, f"{keys}, {_FOUND}")


def _hits(docs: DataFrame, indexes: Iterable[Index], overlap: float) -> DataFrame:
    """row (fingerprint), items, best_score, best_overlap of the rows in which an item of any slice is verified."""
    row = fingerprint("doc_id", "text")
    texts = docs.select(row["a"].alias("a"), row["b"].alias("b"), "text")
    parts = [stored(_judged(texts, index, overlap, "a long, b long", hits_only=True)) for index in indexes]
    rows = reduce(DataFrame.union, parts).withColumn("row", F.struct("a", "b"))
    return rows.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("best_score").alias("best_score"), F.max("best_overlap").alias("best_overlap"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, max_items: int = 20_000) -> DataFrame:
    """doc_id, contaminated, items (leaked item ids, ascending), best_score, best_overlap for every row of docs."""
    indexes = build_indexes(benchmark, max_items=max_items)
    index, second = next(indexes), next(indexes, None)
    rows = docs.select(id_text(), "text")
    if second is None:
        out = _judged(rows, index, overlap, "doc_id string", hits_only=False)
    else:
        hits = _hits(docs, chain([index, second], indexes), overlap)
        out = docs.select(id_text(), fingerprint("doc_id", "text").alias("row")).join(hits, "row", "left")
        out = out.withColumns({"items": F.coalesce("items", F.array().cast("array<long>")), "best_score": F.coalesce("best_score", F.lit(0.0)), "best_overlap": F.coalesce("best_overlap", F.lit(0.0))})
    return typed_id(out).select("doc_id", (F.col("best_overlap") > 0).alias("contaminated"), "items", "best_score", "best_overlap")


def keep_clean(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, max_items: int = 20_000) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item is verified."""
    indexes = build_indexes(benchmark, max_items=max_items)
    index, second = next(indexes), next(indexes, None)
    if second is not None:
        hits = _hits(docs, chain([index, second], indexes), overlap)
        named = docs.select(fingerprint("doc_id", "text").alias("row"), whole(docs).alias("doc"))
        return named.join(hits, "row", "left_anti").select("doc.*")
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            yield batch.filter(pa.array([not index.leaks(t, overlap) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
