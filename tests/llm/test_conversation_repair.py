"""Conversation repair against a search over all edits, row by row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

from vellum.llm import conversation_repair as repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    """The result for the rows of one conversation: least (cost, audit) over all edit sequences."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.sub("[ \t-\r]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        add = lambda cost, c, told, rest: found.append((cost + rest[0], c + rest[1], told + rest[2])) if rest else None
        for role in ("user", "assistant"):
            to = grammar.get((state, role[0]))
            if to and inserts:
                add(5, "I", (f"{role}:",), best(i, to, inserts - 1))
            if to and i < len(rows) and faults[i] not in ("blank", "duplicate"):
                add(1 + 5 * (faults[i] == "truncated"), "R", (f"{role}:{rows[i][3]}",), best(i + 1, to, 3))
        if i < len(rows):
            add(2, "D", (), best(i + 1, state, 3))
            to = grammar.get((state, rows[i][2][:1]))
            if to and faults[i] not in ("blank", "duplicate"):
                add(5 * (faults[i] == "truncated"), "K", (f"{rows[i][2]}:{rows[i][3]}",), best(i + 1, to, 3))
        return min(found, default=None)

    for i in range(len(rows), 0, -50):  # keeps the recursion shallow
        [best(i, state, 3) for state in ("", "s", "u", "a")]
    cost, audit, told = best(0, "", 3)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())


def every(rows, damaged):
    convs = {r[0] for r in rows}
    return sorted(((c, *brute([r for r in damaged if r[0] == c])) for c in convs), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rows_at_random(rng, convs, longest):
    texts = ["Hi.", "Hi", "ok!", "What? ", " ", "", "\t", "Fine.\n", "x ", None, "Yes.", "No", "é?", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "agent", "S", None]
    return [(c, rng.choice([None, *range(6), 2**53 + 1]) if rng.random() < 0.3 else t, rng.choice(roles[: 5 if c % 2 else 10]), rng.choice(texts)) for c in convs for t in range(rng.randrange(longest))]


def test_random_conversations(spark):
    rows = rows_at_random(random.Random(5), range(150), 12)
    rows += [(None, t, "user", "Hi.") for t in range(3)] + [(2**53 + 1, 1, "assistant", "So.")] * 3
    got = sorted(map(tuple, repair.damage_and_repair(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert got == every(rows, damage(rows))


def test_segments_chain(spark, monkeypatch):
    rng = random.Random(8)
    rows = rows_at_random(rng, range(6), 12) + [(50, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", "d?", "", f"{t}."])) for t in range(400)]
    rows += [(51, None, "user", "same.")] * 500 + [(51, t, "user" if t % 2 else "assistant", f"{t}!") for t in range(60)]
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 7)
    pieces = repair.segments(frame(spark, rows))
    assert pieces.filter("conv = 50").count() > 10
    real, monkeypatched = repair.segments, lambda _: pieces  # the workers have the module's own bound
    monkeypatch.setattr(repair, "segments", monkeypatched)
    got = sorted(map(tuple, repair.repair_digests(frame(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(repair, "segments", real)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert got == every(plain, plain)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " "), (3, 0, "user", "So."), (3, 1, "assistant", "No")]
    told = {}
    for r in repair.repaired_turns(frame(spark, rows)).orderBy("conv_id", "part", "nth", "place").collect():
        told.setdefault(r.conv_id, []).append((r.role, r.text))
    assert told == {1: [("user", "You?"), ("assistant", "Yes.")]}  # the third costs 4 to delete, 5 to keep
    digests = {r.conv_id: r for r in repair.repair_digests(frame(spark, rows)).collect()}
    assert (digests[1].audit, digests[1].cost) == ("DKK", 2) and (digests[2].audit, digests[2].cost) == ("D", 2)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.damage_and_repair(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.damage_and_repair(frame(spark, [])).collect() == []
