from __future__ import annotations

import re

import numpy as np

from vellum.llm import jaccard_join
from vellum.llm.components import connected_components


def _set(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows, s=0.8):
    sets = [_set(t) for _, t in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) >= s * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i]] + [group[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    return link, group


def _rows():
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 3)) for _ in range(n))
    rows, doc = [], 0
    for base in range(14):
        text = word(int(rng.integers(6, 160))).split()
        for copy in range(int(rng.integers(1, 9))):
            t = list(text)
            for _ in range(copy // 2):
                t[int(rng.integers(len(t)))] = word(1)
            rows.append((doc := doc + 1, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "a b"), (904, "A, b"), (905, "a b c"), (906, word(3000)), (907, rows[0][1]), (907, rows[0][1]), (None, rows[0][1].upper())]
    return rows


def test_against_brute_force(spark):
    rows = _rows()
    link, group = _brute(rows)
    df = spark.createDataFrame([(d, t, 5, "c", 2) for d, t in rows], "doc_id long, text string, cls int, root string, row int")
    expected = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        expected.append((d, min(own) if own else None, sum(link[i])))
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join_classes(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns
    heads = {}
    for i, (d, t) in enumerate(rows):
        heads.setdefault(group[i], []).append(d)
    want = sorted(min(x for x in ds if x is not None) for ds in heads.values())
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert jaccard_join.join_classes(df.limit(0)).count() == 0 == jaccard_join.keep_first(df.limit(0)).count()


def test_blocks_do_not_change_results(spark):
    rows = [r for r in _rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["cls"]: (r["links"], r["texts"], r["root_doc"]) for r in jaccard_join.similar_documents(df)[1].collect()}
    cut = {r["cls"]: (r["links"], r["texts"], r["root_doc"]) for r in jaccard_join.similar_documents(df, block=2)[1].collect()}
    assert whole == cut


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    runs, met, n = jaccard_join.runs_needed(3, 0.999), 0, 400
    for _ in range(n):
        s = np.unique(rng.integers(0, 1 << 63, 90).astype(np.uint64))
        a, b = s[:85], np.concatenate([s[:76], s[85:]])
        met += bool(np.intersect1d(jaccard_join.paths(a, runs, 3, 0.8), jaccard_join.paths(b, runs, 3, 0.8)).size)
    assert met >= 0.99 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(300, 300), (400, 401), (401, 400), (402, 401)]
    h = lambda i: (i + 1) * 0x9E3779B97F4A7C15 % (1 << 63)  # noqa: E731  nodes are fingerprints
    back = {h(i): i for e in edges for i in e}
    df = spark.createDataFrame([(h(a), h(b)) for a, b in edges], "a long, b long")
    got = {back[r.node]: r.root for r in connected_components(df).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 151)}) == 1 and len({got[i] for i in (400, 401, 402)}) == 1
    assert len(set(got.values())) == 3 and 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
