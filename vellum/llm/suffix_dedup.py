"""Removal of long repeated byte strings, by prefix doubling over sampled suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts elsewhere in the corpus.
Ranking every suffix costs a global sort of all bytes in each round, which no disk budget of a few
times the input allows; so the suffixes are first thinned without losing a match:

1. Doubling inside each text: the rank of the 2h bytes at p is made from the ranks of the h bytes
   at p and at p + h, for h = 1, 2, .. 64.  Ranks are 64-bit fingerprints, since only equality counts.
2. A string of `length` bytes at p takes as its anchor the smallest rank of a 64-byte string inside
   it.  The choice depends on the string's own bytes alone, so equal strings have equal anchors at
   equal places; about one suffix in seventy is an anchor.
3. Spark sorts the anchors by the pair of their rank and the rank of all bytes that their strings
   can reach.  Anchors with a unique rank are dropped with all their strings.  Anchors that tie on
   the pair are past the threshold: all their strings repeat.
4. Anchors that tie in rank only are at the ends of repeats.  One of each set of tied ones goes on
   to the same step with a longer offset (`length` - 20), sampled anew among their strings only.
5. What is still open then is ranked string by string at the full length.

Ranks that occur once, nearly all, are dropped by counting them.  The rest is settled by counts of
(rank, rank of the reach), summed before they are shuffled and joined back, so that a rank with very
many places is spread over many tasks; no task gathers the places of a rank.

Cases: null counts as empty; a text shorter than `length` loses nothing; a text within which a
string repeats loses all its places; equal rows repeat each other; texts that differ only in doc_id
repeat each other; an empty table gives an empty result; further columns are ignored.  Rows are
followed by a 128-bit fingerprint of (doc_id, text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fingerprint, id_text, stored, typed_id

GRAM = 64
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of a string from the ranks of two strings that cover it."""
    z = x * _A
    z += y * _B
    z ^= z >> _S
    return z


def ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 64-byte and of the 128-byte strings at all positions of at least 128 bytes."""
    r, h = _BYTE[data], 1
    while h < GRAM:
        r = _pair(r[:-h], r[h:])
        h *= 2
    return r, _pair(r[:-GRAM], r[GRAM:])


def anchors(r: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and the first and last position whose string chose them."""
    w = length - gram + 1
    k = (r & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(r), dtype=np.uint64)  # ties: the leftmost
    full = np.append(k, np.full(-len(k) % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    chosen = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.append(0, np.flatnonzero(np.diff(chosen)) + 1)
    return chosen[lo], lo, np.append(lo[1:] - 1, m - 1)


def around(r128: np.ndarray, at: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """The rank of all bytes that the strings of each anchor can reach, cut at the ends of the text."""
    s, e = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    z = _pair(_pair(r128[s], r128[(s + e - 2 * GRAM) // 2]), r128[e - 2 * GRAM])
    return _pair(z, ((at - s) * 4096 + (e - s)).astype(np.uint64))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _place(at, lo, hi):
    """An anchor, the bytes back to the first string that chose it, and how many more chose it."""
    return (at << 16) | ((at - lo) << 8) | (hi - lo)


def _span(place):
    """First and last start of the strings of a place."""
    lo = (place >> 16) - ((place >> 8) & 255)
    return lo, lo + (place & 255)


def _frame(names: tuple[str, ...], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(x) if rows else np.zeros(0, np.int64) for c, x in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)})


def _anchors_of(data: np.ndarray, a: int, b: int, length: int, gram: int, mask: np.ndarray | None) -> tuple | None:
    n = len(data)
    if n < length:
        return None
    r, r128 = ranks(data)
    if gram > GRAM:
        r = _pair(r128[: n - gram + 1], r128[gram - 2 * GRAM :][: n - gram + 1])
    at, lo, hi = anchors(r, n, length, gram)
    if mask is not None:
        seen = np.append(0, np.cumsum(mask))
        some = seen[hi + 1] > seen[lo]
        at, lo, hi = at[some], lo[some], hi[some]
    return r[at].view(np.int64), around(r128, at, n, length, gram).view(np.int64), np.full(len(at), a), np.full(len(at), b), _place(at, lo, hi)


def _open(marks, n: int, length: int) -> np.ndarray | None:
    """Which strings of a text belong to marks that are still open."""
    codes = np.asarray(marks if marks is not None else [], np.int64)
    codes = codes[codes & 1 == 1]
    if not len(codes):
        return None
    lo, hi = _span(codes >> 2)
    change = np.zeros(max(n - length + 1, 0) + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    rows = stored(rows)
    often = rows.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1").select(key)
    return rows.join(often, key)


def _settled(sampled: DataFrame) -> DataFrame:
    """a, b (the row) and its marks: place * 4, plus 2 if all strings of the place repeat, plus 1 if it stays open."""
    rows = stored(_repeated(sampled, "rank"))
    at = F.struct("a", "b", "place")
    wides = rows.groupBy("rank", "wide").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    several = wides.groupBy("rank").agg(F.count("*").alias("wides"))
    rows = rows.join(wides.join(several, "rank").filter("n > 1 OR wides > 1"), ["rank", "wide"])
    # one of the places that tie in both goes on, where the rank has others
    code = F.col("place") * 4 + F.when(F.col("n") > 1, 2).otherwise(0) + F.when((F.col("wides") > 1) & (at == F.col("first")), 1).otherwise(0)
    return rows.groupBy("a", "b").agg(F.collect_list(code).alias("marks"))


def find_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """a, b (the row), doc_id (as text), text of docs, with marks_1, marks_2 (see _settled) and the starts of single repeated strings."""
    if not 2 * GRAM + 20 <= length <= 3 * GRAM + 32:  # three 128-byte ranks cover an anchor's reach
        raise ValueError("length must be from 148 to 224 bytes")
    row = fingerprint("doc_id", "text")
    keyed = docs.select(row["a"].alias("a"), row["b"].alias("b"), id_text(), "text")

    def sample(gram: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i, (a, b, data) in enumerate(zip(pdf["a"], pdf["b"], map(_bytes, pdf["text"]), strict=True)):
                    mask = _open(pdf["marks"].iloc[i], len(data), length) if gram > GRAM else None
                    if gram == GRAM or mask is not None:
                        rows.append(_anchors_of(data, a, b, length, gram, mask))
                yield _frame(("rank", "wide", "a", "b", "place"), [r for r in rows if r is not None])

        return run

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, data, marks in zip(pdf["a"], pdf["b"], map(_bytes, pdf["text"]), pdf["marks"], strict=True):
                mask = _open(marks, len(data), length)
                if mask is not None:
                    p, r128 = np.flatnonzero(mask), ranks(data)[1]
                    rows.append((_pair(r128[p], r128[p + length - 2 * GRAM]).view(np.int64), np.full(len(p), a), np.full(len(p), b), p))
            yield _frame(("string", "a", "b", "at"), rows)

    row, wide = ["a", "b"], "rank long, wide long, a long, b long, place long"
    marks_1 = stored(_settled(keyed.select("a", "b", "text").mapInPandas(sample(GRAM), wide)))
    # texts with open strings only; a text's other marks are of no use here
    unsettled = F.exists("marks", lambda m: m.bitwiseAND(F.lit(1)) == 1)
    texts = stored(keyed.select("a", "b", "text").join(marks_1.filter(unsettled), row).dropDuplicates(row))
    marks_2 = stored(_settled(texts.mapInPandas(sample(length - 20), wide)))
    ranked = texts.select("a", "b", "text").join(marks_2.filter(unsettled), row).mapInPandas(strings, "string long, a long, b long, at long")
    single = _repeated(ranked, "string").groupBy("a", "b").agg(F.collect_list("at").alias("starts"))
    out = keyed.join(marks_1.withColumnRenamed("marks", "marks_1"), row, "left")
    return out.join(marks_2.withColumnRenamed("marks", "marks_2"), row, "left").join(single, row, "left")


def covered(n: int, marks_1, marks_2, starts, length: int) -> np.ndarray:
    """Which of n bytes the repeated strings cover."""
    change = np.zeros(n + 1, np.int64)
    for marks in (marks_1, marks_2):
        if marks is not None:
            codes = np.asarray(marks, np.int64)
            lo, hi = _span(codes[codes & 2 == 2] >> 2)
            np.add.at(change, lo, 1)
            np.add.at(change, hi + length, -1)
    if starts is not None:
        np.add.at(change, np.asarray(starts, np.int64), 1)
        np.add.at(change, np.asarray(starts, np.int64) + length, -1)
    return np.cumsum(change[:n]) > 0


def _cut(docs: DataFrame, length: int, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [make(d := _bytes(t), covered(len(d), m1, m2, at, length)) for t, m1, m2, at in zip(pdf["text"], pdf["marks_1"], pdf["marks_2"], pdf["starts"], strict=True)]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    names = [c.split()[0] for c in schema.split(", ")]
    return typed_id(find_repeats(docs, length).mapInPandas(run, f"doc_id string, {schema}"))


def repeat_digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""

    def make(data: np.ndarray, gone: np.ndarray) -> tuple:
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    return _cut(docs, length, make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id and the remaining bytes of its text for every row of docs."""
    return _cut(docs, length, lambda data, gone: (data[~gone].tobytes(),), "kept binary")
