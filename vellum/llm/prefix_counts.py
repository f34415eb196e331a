"""Exact token counts at every prefix, by dynamic programming.

For byte-pair encoding the last token of a prefix's encoding is the one vocabulary suffix t whose
left neighbour u (the last token of the rest) may stand before it: encoding the text of u and t
gives u, t again.  So count[i] = count[i - len(t)] + 1, and one pass over a chunk gives the count
of each of its prefixes.  Chunks are independent (see pieces.py), hence a text's table is the
chunk tables added up, and questions on budgets and truncation read it without encoding again.

Cases: null counts as empty (0 tokens); a character outside the vocabulary costs its UTF-8 bytes.
The library is asked only whether two pieces may stand side by side; both tables are bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vellum.llm.common import id_text, typed_id
from vellum.llm.pieces import MARK, ChunkTable, bare_processor, chunks_of


#: Bounds of the table of prefixes: entries, and characters of one.
MAX_PREFIXES, MAX_PREFIX_CHARS = 300_000, 9


class _Grammar:
    """Vocabulary pieces that encode to themselves, and which may stand side by side."""

    def __init__(self, path: str):
        self.sp = sp = bare_processor(path)
        text = [sp.id_to_piece(i).replace(MARK, " ") for i in range(sp.vocab_size())]
        plain = [t for i, t in enumerate(text) if t and not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {t for t, ids in zip(plain, sp.encode(plain), strict=True) if len(ids) == 1}
        self.longest = max(map(len, self.pieces), default=1)
        self.adjacent: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[int, str]] = {}  # tokens and last token of prefixes met before

    def may_follow(self, u: str, t: str) -> bool:
        key = (u, t)
        known = self.adjacent.get(key)
        if known is None:
            if len(self.adjacent) > 500_000:
                self.adjacent.clear()
            got = self.sp.encode(u + t, out_type=str)
            known = self.adjacent[key] = len(got) == 2 and len(got[0]) == len(u)
        return known

    def table(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i] for i = 1 .. len(chunk); goes on from the longest prefix met before."""
        pieces, n, known = self.pieces, len(chunk), self.prefixes
        count, last = [0] * (n + 1), [""] * (n + 1)
        i = 1
        while i <= n and (got := known.get(chunk[:i])) is not None:
            count[i], last[i] = got
            i += 1
        if len(known) > MAX_PREFIXES:
            known.clear()
        for i in range(i, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = chunk[j:i]
                if t in pieces and (not last[j] or self.may_follow(last[j], t)):
                    count[i], last[i] = count[j] + 1, t
                    break
            else:
                count[i] = count[i - 1] + len(chunk[i - 1].encode())
            if i <= MAX_PREFIX_CHARS:
                known[chunk[:i]] = count[i], last[i]
        return count[1:]


@lru_cache(maxsize=4)
def _grammar(path: str) -> _Grammar:
    return _Grammar(path)


def _tables(path: str, chunks: list[str]) -> list[tuple[int, array]]:
    """For each chunk its token count and the counts of all its prefixes."""
    tables = map(_grammar(path).table, chunks)
    return [(t[-1], array("H" if t[-1] < 30_000 else "l", t)) for t in tables]


@lru_cache(maxsize=4)
def prefix_table(path: str) -> ChunkTable:
    return ChunkTable(lambda new: _tables(path, new))


def prefix_counts(path: str, text: str | None) -> np.ndarray:
    """Token counts of text[:0], text[:1] .. text[:len(text)]."""
    if not text:
        return np.zeros(1, np.int32)
    rows = prefix_table(path).look_up(chunks_of(text))
    before = np.cumsum([0] + [n for n, _ in rows])
    counts = np.concatenate([b + np.array(t, np.int64) for b, (_, t) in zip(before, rows, strict=False)]).astype(np.int32)
    counts[0] = 0  # the dummy prefix alone is the empty text
    return counts


def count(path: str, text: str | None) -> int:
    """Tokens of the whole text: the last entry of its prefix table."""
    return sum([n for n, _ in prefix_table(path).look_up(chunks_of(text))]) if text else 0


def truncate(path: str, text: str | None, budget: int) -> str:
    """The longest prefix with at most `budget` tokens (counts can fall as a prefix grows)."""
    return (text or "")[: int(np.flatnonzero(prefix_counts(path, text) <= max(budget, 0))[-1])]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = np.array([count(path, t) for t in pdf["text"]], np.int64)
            size = np.array([len(t.encode()) if t else 0 for t in pdf["text"]], np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": size, "n_tokens": tokens, "over_limit": tokens > limit})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean"))


def truncate_documents(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix of its text within the budget."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [truncate(path, t, budget) for t in pdf["text"]]})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, text string"))
