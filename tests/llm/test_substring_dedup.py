"""Window removal against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import substring_dedup


def brute(rows, k=13):
    texts = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for q in range(len(w) - k + 1):
            first[tuple(w[q : q + k])] = min(first.get(tuple(w[q : q + k]), i), i)
    out = []
    for (i, w), (doc_id, _) in zip(texts, rows, strict=True):
        gone = {p for q in range(len(w) - k + 1) if first[tuple(w[q : q + k])] < i for p in range(q, q + k)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, substring_dedup.repeat_digests(docs, **more).collect()), key=repr)


def test_edge_cases(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, None), (6, ""), (7, " \t\n "), (8, "short text"), (None, "x " + passage), (9, passage), (2**53 + 1, passage + " tail"), (2**53, passage.upper()),
        (2**53 + 1, passage.upper()), (10, passage), (10, passage), (11, "same " * 60), (12, "same " * 13), (12, "a b " * 14), (13, "a b\x1f " * 14), (14, "z\r\n" + passage.replace(" ", "\x0b\t") + "\f"),
        (20, "only here " * 30), (-4, " ".join(f"w{i}" for i in range(20, 33))), (21, " ".join(f"w{i}" for i in range(20, 32))),
    ]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_random_texts(spark, window):
    rng = random.Random(window)
    rows = []
    for i in range(120):
        words = [rng.choice("abcde") for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):  # pieces of earlier texts at any offset
            other = (rng.choice(rows)[1] or "").split() if rows else []
            at = rng.randrange(len(other) + 1)
            words[rng.randrange(len(words) + 1) :] = other[at : at + rng.randrange(30)]
        rows.append((rng.randrange(80), " ".join(words)))
    assert found(spark, rows, window=window) == brute(rows, window)


def test_many_copies_and_a_long_text(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    rows = [(1, "the " * 5_000), (2, long), (3, " ".join(long.split()[150_000:150_100]))] + [(4 + i % 7, "one text that has many copies and is longer than a single window of words") for i in range(3_000)]
    assert found(spark, rows) == brute(rows)


def test_runs_and_kept_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, f"x y {a} z"), (3, a), (4, f"{a} {b}"), (5, f"{b} {a} q {b}")], "doc_id long, text string")
    docs = docs.withColumns({"unit": F.lit(1), "keys": F.lit("x"), "id": F.lit(None).cast("string")})
    rows = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert rows == {1: (a, []), 2: ("x y z", [(2, 32)]), 3: ("", [(0, 30)]), 4: (b, [(0, 30)]), 5: ("q", [(0, 60), (61, 91)])}


def test_empty_table(spark):
    assert found(spark, []) == []
