from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

from vellum.llm import suffix_dedup


def _brute(rows, length):
    seen = Counter(d[i : i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    out = []
    for doc, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(1, 6))) for _ in range(n))
    shared, other = word(120), word(60)
    rows = [(i, word(rng.integers(1, 200))) for i in range(30)]
    rows += [(100 + i, word(i) + shared[i * 3 : 430 - i * 5] + word(2 * i)) for i in range(12)]
    rows += [(200 + i, other) for i in range(4)] + [(300, word(3) + other + word(9) + other[:210]), (301, other[:199]), (302, other[5:205])]
    rows += [(400, "a" * 700), (401, "ab" * 200), (402, None), (403, ""), (404, "x" * 200), (405, word(400)), (405, "same id, other text"), (200, other)]
    rows += [(500 + i, shared[:i] + "Ω" + shared[i:]) for i in range(90, 300, 41)] + [(None, shared)]
    df = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, n long, row string")
    for length in (200, 148, 224):
        assert sorted(map(tuple, suffix_dedup.repeat_digests(df, length).collect()), key=str) == _brute(rows, length)
    assert suffix_dedup.repeat_digests(df.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df.filter("doc_id in (200, 201, 405)")).collect()}
    assert kept[201] == b""
