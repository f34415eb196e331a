from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from vellum.llm import sharding, topk_search


def _brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    for block, query_block in ((8192, 1024), (16, 1)):
        got = topk_search.top_k(df, every=10, k=5, block=block, query_block=query_block).collect()
        assert {tuple(r) for r in got} == _brute(rows, 10, 5) and len(got) == len(_brute(rows, 10, 5))
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeated_ids_ties_and_wide_values(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (100, 2):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df, every=10, k=3, block=block).collect())
        u = 256 * 256
        assert got == sorted([(0, 1, 4, 2 * u), (0, 2, 1, u), (0, 3, 1, u), (0, 1, 1, 2 * u), (0, 2, 1, 2 * u), (0, 3, 2, u)])
    big = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [1.0, 2.0**40]), (2, [-1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(big).orderBy("rank").collect()] == [(1, 2**57), (2, 3 * 2**16 - 2**56)]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [2.0**60]), (1, [2.0**60])], "vec_id long, embedding array<double>")).collect()


def _brute_shards(rows, n):
    """doc_id -> (shard, slot) by plain loops over the order, with the cuts moved to the ends of small groups."""
    order = [r for r in rows]
    total, largest = sum(r["size"] for r in order), max(r["size"] for r in order)
    begin, at = [], 0
    for r in order:
        begin.append(at)
        at += r["size"]
    cuts = []
    for k in range(1, n):
        target = total * k // n
        i = max(j for j in range(len(order)) if begin[j] <= target)
        same = [j for j in range(len(order)) if order[j]["group"] == order[i]["group"]]
        lo, hi = same[0], same[-1] + 1
        end = lambda j: begin[j] if j < len(order) else total
        a, b = (lo, hi) if end(hi) - end(lo) <= max(largest, total // (100 * n)) else (i, i + 1)
        cuts.append(a if target - end(a) <= end(b) - target else b)
    out = {}
    for j, r in enumerate(order):
        shard = sum(j >= c for c in cuts)
        out[r["doc_id"]] = (shard, j - ([0, *cuts][shard]))
    return out


def test_shards_against_plain_loops(spark):
    rng = np.random.default_rng(21)
    texts = [f"text {i} " + "w" * int(rng.integers(0, 200)) for i in range(60)] + ["a viral text " * 9] * 60 + ["v" * 5000]
    rows = [(i, texts[int(rng.integers(len(texts)))]) for i in range(700)] + [(800, None), (801, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS grp", "crc32(cast(coalesce(text, '') AS binary)) AS crc", "octet_length(coalesce(text, '')) + 1 AS size", "text IS NULL AS none").collect()
    order = sorted(keyed, key=lambda r: (r.grp, r.crc, r["size"], r.none, r.doc_id))
    want = _brute_shards([{"doc_id": r.doc_id, "size": r["size"], "group": (r.grp, r.crc, r["size"], r.none)} for r in order], 8)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(df, 8).collect()}
    assert got == want


def test_written_shards_hold_every_document(spark, tmp_path):
    rows = [(i % 50, "t" * (i % 70), "k", i) for i in range(200)] + [(None, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, shard int")
    name = sharding.write_shards(df, str(tmp_path / "out"), 4, files=12)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_1" and sorted(map(repr, back.select(df.columns).collect())) == sorted(map(repr, df.collect()))
    sizes = [r[1] for r in back.selectExpr(name, "octet_length(coalesce(text, '')) + 1 AS s").groupBy(name).sum("s").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2 * 70 + sum(sizes) // 100


def _check(rows, got, n):
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((d is not None, d or 0) for d, _ in rows)
    sizes, total = [0] * n, sum(len((t or "").encode()) + 1 for _, t in rows)
    for r in got:
        sizes[r.shard] += r.size
    biggest = max(len((t or "").encode()) + 1 for _, t in rows)
    assert all(abs(s - total / n) <= biggest for s in sizes)
    for s in range(n):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    texts = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 90) + str(i)) for i in range(300)] + [(i, "same ä text") for i in range(300, 420)] + [(500, None), (501, ""), (502, "y" * 400), (None, "no id")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, law string, size int")
    got = sharding.shard_by_bytes(df, 8).collect()
    _check(rows, got, 8)
    small = [(i, f"copy {i // 3} " + "z" * 20) for i in range(90)] + [(1000, "q" * 300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(small, "doc_id long, text string"), 8).collect()
    _check(small, got, 8)
    shard = {r.doc_id: r.shard for r in got}
    assert all(len({shard[3 * g + j] for j in range(3)}) == 1 for g in range(30))
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
    one = sharding.shard_by_bytes(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert len(one) == 2
