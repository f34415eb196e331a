"""Token alignment against the two libraries on whole texts and a plain search for common ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import token_alignment
from vellum.llm.queries import model_path

A, B = model_path("byte_bpe_50k.json"), model_path()


def whole_tokens():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    a_of, b_of = token_alignment.a_bytes(A), token_alignment.b_bytes(B)

    def tokens(text):
        if not text:
            return None
        want = (" " + text).encode()
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        if b"".join(a_of[i] for i in a) != want or b"".join(b_of[i] for i in b) != want:
            return None
        return [(i, a_of[i]) for i in a], [(i, b_of[i]) for i in b]

    return tokens


def brute(rows):
    tokens, found, counts = whole_tokens(), [], Counter()
    for doc_id, text in rows:
        got = tokens(text)
        if got is None:
            found.append((doc_id, 0, 0, [], ""))
            continue
        ends = []
        for side in got:
            at, out = 0, {}
            for k, (i, x) in enumerate(side):
                at += len(x)
                out[at] = (k, i)
            ends.append(out)
        links, spelt, since = [], [], [0, 0]
        for at in sorted(ends[0].keys() & ends[1].keys()):
            upto = [e[at][0] + 1 for e in ends]
            spelt.append("|".join(",".join(str(i) for i, _ in side[s:u]) for side, s, u in zip(got, since, upto, strict=True)))
            since = upto
            links.append((ends[0][at][1], ends[1][at][1]))
        counts.update(links)
        found.append((doc_id, *map(len, got), links, hashlib.sha256(";".join(spelt).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, a, b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, x, h in found), key=repr)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, token_alignment.alignment_digests(docs, A, B).collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Tokens", " ", "  ", "   \n", "\n", "\t\t", "\r\n", "naïve", "日本語", "😀👍", "don't", "'s", "12345", "<s>", "</s>", "<|endoftext|>", "<0x41>", "é", "é", "…", "x" * 30, "\x00", "\x1c", "(a)", ".", "http://a.b/c?d=e", "நன்றி"]
    some = [" ", " ", " ", "　", "\u0085", "▁", "​", "﻿"]
    return ["".join(rng.choice(parts if rng.random() < 0.96 or k % 3 else some) for _ in range(rng.randrange(1, 60))) for k in range(n)]


def test_against_the_libraries(spark):
    rows = list(enumerate(texts(400, 1))) + [(None, "null id"), (2**53 + 1, "big id"), (2**53, "big id"), (7, None), (8, ""), (9, " "), (10, "a"), (10, "a"), (11, "▁"), (12, "a  "), (13, "\n")]
    assert result(spark, rows) == brute(rows)


def test_long_texts_and_copies(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "Beta", "γ", "x1y2", "tokenization"]) + rng.choice(["", ",", "!", "\n"]) for _ in range(40_000))
    rows = [(1, long), (2, "z" * 5_000), (3, "日本" * 3_000)] + [(4 + i, "a copied text of some words") for i in range(500)]
    assert result(spark, rows) == brute(rows)


def test_sweep_with_any_runs():
    """Groups do not depend on where the runs are cut; ends that never meet close nothing."""
    rng = random.Random(3)
    lengths = {s: np.array([1, 2, 3, 5]) for s in "ab"}
    for _ in range(200):
        ids = {s: np.array([rng.randrange(4) for _ in range(rng.randrange(1, 40))]) for s in "ab"}
        ends = {s: np.cumsum(lengths[s][x]) for s, x in ids.items()}
        want = sorted(set(ends["a"]) & set(ends["b"]))
        runs = []
        for s, x in ids.items():
            at = k = 0
            while k < len(x):
                n = rng.randrange(1, 6)
                runs.append((at, s, x[k : k + n]))
                at, k = at + int(lengths[s][x[k : k + n]].sum()), k + n
        sweep, got, seen = token_alignment.Sweep(lengths), [], {"a": [], "b": []}
        for at, s, x in sorted(runs, key=lambda r: r[:2]):
            closed = sweep.feed(s, at, x)
            if closed:
                got += closed[0].tolist()
                seen["a"] += closed[1].tolist()
                seen["b"] += closed[3].tolist()
        assert got == want
        for s in "ab":
            assert seen[s] == ids[s][: int(np.searchsorted(ends[s], want[-1], "right")) if want else 0].tolist()


def test_groups(spark):
    docs = spark.createDataFrame([(1, "Tokenizers differ, naïvely."), (2, "▁"), (3, None)], "doc_id long, text string")
    rows = token_alignment.groups(docs, A, B).orderBy("end").collect()
    a_of, b_of = token_alignment.a_bytes(A), token_alignment.b_bytes(B)
    for side, of in (("a_ids", a_of), ("b_ids", b_of)):
        assert b"".join(of[i] for r in rows for i in r[side]) == " Tokenizers differ, naïvely.".encode()
    assert all(b"".join(a_of[i] for i in r.a_ids) == b"".join(b_of[i] for i in r.b_ids) for r in rows)


def test_pairs_hold_every_link():
    pairs = token_alignment.Pairs([b"a", b"ba", b"cba"], [b"ba", b"a", b"xa", b"c", b"a"])
    want = sorted(i * 5 + j for i, x in enumerate([b"a", b"ba", b"cba"]) for j, y in enumerate([b"ba", b"a", b"xa", b"c", b"a"]) if x.endswith(y) or y.endswith(x))
    assert pairs.codes.tolist() == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "▁")]])
def test_nothing_to_align(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_texts_of_a_batch_share_a_call(monkeypatch):
    texts = [f"firstly{k} new{k}ly words" for k in range(40)] + ["a b", "x▁y", " ", "plain\n\n text"]
    for name, path in (("a", model_path("byte_bpe_50k.json")), ("b", model_path())):
        own, calls = token_alignment.Side(name, path), []
        single = [token_alignment.Side(name, path).encode(t) for t in texts[-6:]]
        make = own.table.make
        monkeypatch.setattr(own.table, "make", lambda new, make=make, calls=calls: calls.append(len(new)) or make(new))
        got = list(own.encode_all(texts))
        assert len(calls) == 1 and [None if x is None else x.tolist() for x in got[-6:]] == [None if x is None else x.tolist() for x in single]
