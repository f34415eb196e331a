"""Exact SentencePiece encoding, decoding and token counts through a distinct-chunk table.

No piece of the vocabulary holds a white-space marker after another character, and none mixes a
line feed with anything, so a text falls into chunks (markers followed by a word, or line feeds)
that no merge can cross.  A chunk is segmented by the library itself and its ids are kept in a table;
documents join the results back by position.  The table is bounded and belongs to one Python worker:
long chunks are not kept, and a full table is emptied, so that memory does not follow the corpus.
Over a cluster a common chunk is therefore segmented a few times, not once, which costs less than a
shuffle of all distinct chunks.  The library takes the new chunks of many texts in one call, as a call
starts threads of its own, which takes longer than segmenting the chunks of one text.

Cases: null counts as empty; the empty text has no ids; U+2581 is the marker itself and decodes to
a space, as in the library; lone special strings such as <s> are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vellum.llm.common import id_text, typed_id

MARK = "▁"
#: Chunks longer than this are segmented each time, and a table beyond this many entries is emptied.
MAX_KEPT_CHARS, MAX_KEPT = 48, 600_000
#: Characters of the texts that are looked up together.
TOGETHER = 1 << 20
_CHUNK = re.compile(r" +[^ \n]*|\n+|[^ \n]+")


def chunks_of(text: str) -> list[str]:
    """The chunks of a non-empty text, the dummy prefix included."""
    return _CHUNK.findall(" " + text.replace(MARK, " "))


@lru_cache(maxsize=4)
def bare_processor(path: str):
    """The library's processor for the model, without the dummy prefix.

    Raises ValueError where the model's pieces can cross white space, or its normaliser changes text.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    crosses = any(MARK in p.piece.lstrip(MARK) or ("\n" in p.piece and p.piece.strip("\n")) for p in model.pieces)
    if crosses or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("chunks of this model are not independent")
    spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class ChunkTable:
    """chunk -> what `make` gives for a list of new chunks, with bounded memory."""

    def __init__(self, make):
        self.make, self.kept = make, {}

    def look_up(self, chunks: list[str]) -> list:
        get = self.kept.get
        out = [get(c) for c in chunks]
        if None in out:
            new = list(dict.fromkeys([c for c, v in zip(chunks, out, strict=True) if v is None]))
            made = dict(zip(new, self.make(new), strict=True))
            out = [made[c] if v is None else v for c, v in zip(chunks, out, strict=True)]
            if len(self.kept) + len(made) > MAX_KEPT:
                self.kept.clear()
            self.kept.update((c, v) for c, v in made.items() if len(c) <= MAX_KEPT_CHARS)
        return out

    def look_up_all(self, lists: list[list[str]]) -> Iterator[list]:
        """look_up for each list, with one call of `make`."""
        found, at = self.look_up([c for chunks in lists for c in chunks]), 0
        for chunks in lists:
            yield found[at : at + len(chunks)]
            at += len(chunks)


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of at most TOGETHER characters; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t or "") > TOGETHER:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t or "")
    if run:
        yield run


def _coded(path: str, chunks: list[str]) -> list[tuple[int, str, str]]:
    sp = bare_processor(path)
    ids = sp.encode(chunks, num_threads=1)
    return [(len(i), ",".join(map(str, i)), d) for i, d in zip(ids, sp.decode(ids), strict=True)] if chunks else []


@lru_cache(maxsize=4)
def code_table(path: str) -> ChunkTable:
    return ChunkTable(lambda new: _coded(path, new))


def encode(path: str, text: str | None) -> list[int]:
    return [int(i) for _, ids, _ in code_table(path).look_up(chunks_of(text)) for i in ids.split(",")] if text else []


def decode(path: str, ids: list[int]) -> str:
    return bare_processor(path).decode(ids).removeprefix(" ") if ids else ""


def digests(path: str, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """Of each text: number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
    for run in together(texts):
        for rows in code_table(path).look_up_all([chunks_of(t) if t else [] for t in run]):
            ids = ",".join([r[1] for r in rows])
            back = "".join([r[2] for r in rows]).removeprefix(" ")
            yield sum([r[0] for r in rows]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def digest(path: str, text: str | None) -> tuple[int, str, str]:
    return next(digests(path, [text]))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for every row: the operator's plain output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [encode(path, t) for t in pdf["text"]]})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, ids array<int>"))


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, ids, back = zip(*digests(path, pdf["text"].tolist()), strict=True) if len(pdf) else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(n, np.int64), "ids_sha256": ids, "decoded_sha256": back})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
