"""Alignment of two tokenizers' tokens by one sweep over the places where tokens end.

A is a byte-level BPE of space+text, B a SentencePiece model of text (which adds the space).  Each encoder
turns a text into events, the byte offsets where its tokens end.  Events of both are united, dealt by text,
sorted by offset, and a machine that keeps the tokens since the last common end goes over them: where an A
and a B token end together a group closes, and these two tokens are linked.

An event row holds a run of up to `RUN` successive tokens by their ids and the offset where the first
begins; as an id tells a token's length, this is all of its events in two bytes each.  So the machine's
state is a run of each side and the open group.  Equal texts are merged first (copies meet before the
shuffle) and count as often as they occur.

A link's tokens end together, so the bytes of one are the end of the other's: the possible pairs of ids
follow from the two vocabularies alone (`Pairs`), some hundred thousand whatever the corpus.  Their counts
over the corpus are therefore one array of proven size, summed by Spark and sent to the tasks that need it.

Cases: texts that are null or empty, or whose joined tokens differ from space+text (such as those with
U+2581, which B reads as a space), have no tokens; special strings are ordinary text; repeated rows and
equal texts each give a row; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fingerprint, shuffle_partitions, stored
from vellum.llm.pieces import MARK, ChunkTable, bare_processor, chunks_of, together

#: Tokens of an event row at most.
RUN = 8192
#: Where A's words part, for texts whose white space is ASCII: all but the last of a run of white space, a
#: word with one space before it, a single other white space.
_WORD = re.compile(r"[ \t-\r]+(?![^ \t-\r])| ?[^ \t-\r]+|[\t-\r]")
_OTHER_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores; threads inside them double the CPU time
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=4)
def a_bytes(path: str) -> list[bytes]:
    """The bytes of each of A's tokens."""
    letters, vocabulary = _byte_letters(), _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


@lru_cache(maxsize=4)
def b_bytes(path: str) -> list[bytes]:
    """The bytes of each of B's tokens."""
    sp = bare_processor(path)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.vocab_size())]


class Side:
    """An encoder with its token bytes; ids of a text as an array, or None where the tokens are not space+text."""

    def __init__(self, name: str, path: str):
        self.name, self.path = name, path
        self.bytes = a_bytes(path) if name == "a" else b_bytes(path)
        if not all(self.bytes):
            raise ValueError("a token without bytes has no end of its own")
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.kind = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.table = ChunkTable(self._coded)

    def _raw(self, chunks: list[str]) -> list[list[int]]:
        if not chunks:
            return []
        if self.name == "b":
            return bare_processor(self.path).encode(chunks, num_threads=1)
        return [x.ids for x in _tokenizer(self.path).encode_batch(chunks, add_special_tokens=False)]

    def _coded(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; empty where they do not spell it."""
        each, data = self._raw(chunks), [c.encode() for c in chunks]
        flat = [i for ids in each for i in ids]
        blob, size, at = np.array(flat, self.kind).tobytes(), np.dtype(self.kind).itemsize, 0
        lengths = [sum([len(self.bytes[i]) for i in ids]) for ids in each]
        spelt = list(map(len, data)) == lengths and b"".join([self.bytes[i] for i in flat]) == b"".join(data)
        out = []
        for ids, chunk in zip(each, data, strict=True):
            end = at + len(ids) * size
            out.append(blob[at:end] if spelt or b"".join([self.bytes[i] for i in ids]) == chunk else b"")
            at = end
        return out

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a text that the table holds; none for a text that is not cut, or has no tokens."""
        if MARK in text or self._uncut(text):
            return []
        return chunks_of(text) if self.name == "b" else _WORD.findall(" " + text)

    def _uncut(self, text: str) -> bool:
        return self.name == "a" and _OTHER_WHITE.search(text) is not None

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """encode for each text, the new chunks of many texts in one call."""
        for run in together(texts):
            for text, parts in zip(run, self.table.look_up_all([self._chunks(t) for t in run]), strict=True):
                if MARK not in text and self._uncut(text):
                    parts = self._coded([" " + text])
                yield np.frombuffer(b"".join(parts), self.kind) if MARK not in text and all(parts) else None

    def encode(self, text: str) -> np.ndarray | None:
        return next(self.encode_all([text]))


@lru_cache(maxsize=8)
def side(name: str, path: str) -> Side:
    return Side(name, path)


class Pairs:
    """The pairs of ids whose bytes can end together, numbered in order of (a, b)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        def ends(longer: list[bytes], by: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
            for i, x in enumerate(longer):
                for k in range(len(x)):
                    for j in by.get(x[k:], ()):
                        yield i, j

        def by(tokens: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, x in enumerate(tokens):
                out.setdefault(x, []).append(i)
            return out

        self.width = len(b)
        codes = {i * self.width + j for i, j in ends(a, by(b))} | {i * self.width + j for j, i in ends(b, by(a))}
        self.codes = np.array(sorted(codes), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a.astype(np.int64) * self.width + b).astype(np.uint32)


@lru_cache(maxsize=2)
def pairs_of(a_path: str, b_path: str) -> Pairs:
    return Pairs(a_bytes(a_path), b_bytes(b_path))


class Sweep:
    """The machine: takes runs of both sides in order of offset, gives groups up to the last common end."""

    def __init__(self, lengths: dict[str, np.ndarray]):
        self.lengths = lengths
        self.ids = {s: np.zeros(0, np.int64) for s in "ab"}
        self.ends = {s: np.zeros(0, np.int64) for s in "ab"}

    def feed(self, name: str, at: int, ids: np.ndarray) -> tuple | None:
        """Ends of the closed groups, and for either side the ids and the number of ids up to each of these ends."""
        ends = at + np.cumsum(self.lengths[name][ids])
        self.ids[name] = np.concatenate([self.ids[name], ids.astype(np.int64)])
        self.ends[name] = np.concatenate([self.ends[name], ends])
        a, b = self.ends["a"], self.ends["b"]
        if not (len(a) and len(b)):
            return None
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        closed = np.flatnonzero(b[place] == a)
        if not len(closed):
            return None
        upto_a, upto_b = closed + 1, place[closed] + 1
        out = a[closed], self.ids["a"][: upto_a[-1]], upto_a, self.ids["b"][: upto_b[-1]], upto_b
        for s, n in (("a", upto_a[-1]), ("b", upto_b[-1])):
            self.ids[s], self.ends[s] = self.ids[s][n:], self.ends[s][n:]
        return out


def _firsts(upto: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of n ids is the first of its group, and the group's number."""
    first = np.zeros(n, np.int64)
    first[np.append(0, upto[:-1])] = 1
    return first, np.cumsum(first) - 1


@lru_cache(maxsize=8)
def _spellings(n: int, first: str) -> np.ndarray:
    """Ids as decimals after a comma, then after `first`."""
    return np.array([f",{i}" for i in range(n)] + [f"{first}{i}" for i in range(n)], object)


def spelt_groups(a: np.ndarray, upto_a: np.ndarray, b: np.ndarray, upto_b: np.ndarray, n_a: int, n_b: int) -> str:
    """`;a1,a2|b1` for each group."""
    first_a, group_a = _firsts(upto_a, len(a))
    first_b, group_b = _firsts(upto_b, len(b))
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.append(0, upto_b)[group_a]] = _spellings(n_a, ";")[a + n_a * first_a]
    out[np.arange(len(b)) + upto_a[group_b]] = _spellings(n_b, "|")[b + n_b * first_b]
    return "".join(out.tolist())


def distinct_texts(docs: DataFrame) -> DataFrame:
    """a, b, copies, text of every different text that is not null or empty."""
    rows = docs.filter("text <> ''").select(fingerprint("text").alias("f"), "text")
    return rows.groupBy(F.col("f.a").alias("a"), F.col("f.b").alias("b")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))


_EVENT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("copies", pa.int64()), ("at", pa.int64()), ("side", pa.string()), ("ids", pa.binary())])


def events(texts: DataFrame, name: str, path: str) -> DataFrame:
    """The events of one side: a, b, copies, at, side, ids; a text that is not spelt gives one row without ids at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = side(name, path)
        for batch in batches:
            rows, at, ids, held = [], [], [], 0

            def made(rows=rows, at=at, ids=ids, batch=batch) -> pa.RecordBatch:
                key = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("a", "b", "copies")]
                return pa.RecordBatch.from_arrays([*key, pa.array(at, pa.int64()), pa.array([name] * len(at), pa.string()), pa.array(ids, pa.binary())], schema=_EVENT)

            for i, found in enumerate(own.encode_all(batch.column("text").to_pylist())):
                if found is None:
                    rows.append(i), at.append(-1), ids.append(None)
                    continue
                begin = 0
                for k in range(0, len(found), RUN):
                    part = found[k : k + RUN]
                    rows.append(i), at.append(begin), ids.append(part.tobytes())
                    begin += int(own.lengths[part].sum())
                    held += part.nbytes
                if held > 16 << 20:
                    yield made()
                    held = 0
                    rows.clear(), at.clear(), ids.clear()
            if rows:
                yield made()

    return texts.mapInArrow(run, "a long, b long, copies long, at long, side string, ids binary")


def sorted_events(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    both = events(texts, "a", a_path).unionByName(events(texts, "b", b_path))
    return both.repartition(shuffle_partitions(texts.sparkSession), "a", "b").sortWithinPartitions("a", "b", "at", "side")


def _swept(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple]:
    """(key, 'text', copies) for each text that is spelt, then (key, 'run', side, ids) and (key, 'groups', ...) as they close."""
    kinds = {"a": side("a", a_path), "b": side("b", b_path)}
    key, sweep = None, None
    for batch in batches:
        for a, b, copies, at, name, ids in zip(*[batch.column(c).to_pylist() for c in _EVENT.names], strict=True):
            if (a, b) != key:
                key, sweep = (a, b), None if at < 0 else Sweep({s: x.lengths for s, x in kinds.items()})
                if sweep:
                    yield key, "text", copies
            if sweep is None:
                continue
            found = np.frombuffer(ids, kinds[name].kind)
            yield key, "run", name, found
            closed = sweep.feed(name, at, found)
            if closed:
                yield key, "groups", *closed


_TEXT = pa.schema([*[(c, pa.int64()) for c in ("a", "b", "copies", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each different text that has tokens: a, b, copies, numbers, groups_sha256, and its links as numbers of pairs (see Pairs) with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n_a, n_b = pairs_of(a_path, b_path), len(a_bytes(a_path)), len(b_bytes(b_path))
        rows: list[dict] = []
        now: dict = {}

        def close() -> None:
            if now:
                found = now.pop("found")
                pairs, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32),) * 2
                rows.append(now | {"n_groups": now["n_links"], "groups_sha256": now["groups_sha256"].hexdigest(), "pairs": pairs.astype(np.uint32).tobytes(), "times": times.astype(np.uint32).tobytes()})

        for key, what, *more in _swept(batches, a_path, b_path):
            if what == "text":
                close()
                now = {"a": key[0], "b": key[1], "copies": more[0], "n_a": 0, "n_b": 0, "n_links": 0, "groups_sha256": hashlib.sha256(), "found": []}
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_pylist(rows, _TEXT)
                    rows.clear()
            elif what == "run":
                now[f"n_{more[0]}"] += len(more[1])
            else:
                _, a, upto_a, b, upto_b = more
                spelt = spelt_groups(a, upto_a, b, upto_b, n_a, n_b)
                now["groups_sha256"].update(spelt[not now["n_links"] :].encode())
                now["found"].append(numbers.number(a[upto_a - 1], b[upto_b - 1]))
                now["n_links"] += len(upto_a)
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TEXT)

    schema = "a long, b long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return sorted_events(distinct_texts(docs), a_path, b_path).mapInArrow(run, schema)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """text_a, text_b (the text's fingerprint), end (byte offset), a_ids, b_ids of every group; the last of either is linked."""
    schema = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, what, *more in _swept(batches, a_path, b_path):
            if what == "groups":
                ends, a, upto_a, b, upto_b = more
                parts = [pa.ListArray.from_arrays(np.append(0, upto).astype(np.int32), pa.array(x.astype(np.int32))) for x, upto in ((a, upto_a), (b, upto_b))]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ends), pa.int64()) for k in key] + [pa.array(ends, pa.int64()), *parts], schema=schema)

    return sorted_events(distinct_texts(docs), a_path, b_path).mapInArrow(run, "text_a long, text_b long, end long, a_ids array<int>, b_ids array<int>")


def pair_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How often each of n possible pairs is linked in all copies of the texts: n numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for copies, pairs, times in zip(*[batch.column(c).to_pylist() for c in ("copies", "pairs", "times")], strict=True):
                total[np.frombuffer(pairs, np.uint32)] += copies * np.frombuffer(times, np.uint32).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": found, "n": total[found]}, pa.schema([("pair", pa.int64()), ("n", pa.int64())]))

    summed = texts.select("copies", "pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n, np.int64)
    counts[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    return counts


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    texts = stored(aligned(docs, a_path, b_path))
    pairs = pairs_of(a_path, b_path)
    counts = pair_counts(texts, len(pairs.codes))
    of_b = pairs.codes % pairs.width
    highest = np.zeros(pairs.width, np.int64)
    np.maximum.at(highest, of_b, counts)
    told = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))
    schema = pa.schema([*[(c, pa.int64()) for c in ("a", "b", "n_best", "count_sum")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = told.value
        for batch in batches:
            rows = []
            for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                pairs, times = np.frombuffer(pairs, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
                rows.append((int(times[best[pairs]].sum()), int((times * counts[pairs]).sum())))
            sums = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], []))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sums], schema=schema)

    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    summed = texts.select("a", "b", "pairs", "times").mapInArrow(run, "a long, b long, n_best long, count_sum long")
    each = texts.select("a", "b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(summed, ["a", "b"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("f")).select("doc_id", "f.a", "f.b")
    return rows.join(each, ["a", "b"], "left").select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
