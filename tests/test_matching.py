"""Import classification against an import that goes record by record."""

from __future__ import annotations

import random

import pytest

from vellum import dims
from vellum.operators import importing

ITEM = "id string, logical_key string, match_key string, language_code string, resource_role string, content_type string, content_hash string, sequence_no int, protection_level string, created_at long"
ROLES = ["footnotes", "cross_references", "study_notes", "source_scripture", "target_scripture", "introductions"]
KINDS = ["footnote", "footnote", "cross_reference", "section_heading", "paragraph", "scripture"]


def record_by_record(incoming, stored):
    """id -> (status, cross_role, anchor id) as the rows come; dictionaries stand for the item table."""
    own = {"footnote": "footnotes", "cross_reference": "cross_references", "section_heading": "study_notes"}
    inside = ("source_scripture", "target_scripture")
    by_key, newest = {}, {}
    for x in sorted(stored, key=lambda x: x["id"], reverse=True):
        by_key[x["logical_key"]] = x
    for x in sorted(stored, key=lambda x: (x["created_at"], x["id"])):
        newest[x["match_key"], x["language_code"] or ""] = x
    out = {}
    for x in sorted(incoming, key=lambda x: (x["sequence_no"], x["id"])):
        held, cross = by_key.get(x["logical_key"]), False
        if held is None and x["match_key"] is not None and x["content_type"] in dims.MATCHED_TYPES:
            other, mine = newest.get((x["match_key"], x["language_code"] or "")), own.get(x["content_type"])
            if other and mine and ((x["resource_role"] == mine and other["resource_role"] in inside) or (other["resource_role"] == mine and x["resource_role"] in inside)):
                held, cross = other, True
        if held is None:
            by_key[x["logical_key"]] = x
            if x["match_key"] is not None:
                newest[x["match_key"], x["language_code"] or ""] = x
        out[x["id"]] = ("new" if held is None else "identical" if held["content_hash"] == x["content_hash"] else "conflict", cross, held and held["id"])
    return out


def items(rng, n, prefix, keys, match_keys, first=0, kinds=KINDS):
    rows = []
    for i in range(n):
        m = rng.choice(match_keys)
        role, lang = rng.choice(ROLES), rng.choice(["en", "en", None])
        # a semantic key mostly belongs to one match key, sometimes to any
        semantic = f"{m}-{rng.randrange(keys)}" if rng.random() < 0.8 else f"any-{rng.randrange(keys)}"
        rows.append({"id": f"{prefix}{i:05}", "logical_key": f"{role}|{lang or ''}|{semantic}", "match_key": m, "language_code": lang, "resource_role": role, "content_type": rng.choice(kinds), "content_hash": rng.choice("xyz"), "sequence_no": first + rng.randrange(n), "protection_level": rng.choice(["normal", "protected_scripture", None]), "created_at": rng.randrange(5)})
    return rows


def frame(spark, rows):
    names = [c.split()[0] for c in ITEM.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ITEM)


def found(spark, incoming, stored, few):
    rows = importing.classify(frame(spark, incoming).repartition(3), frame(spark, stored), few=few).collect()
    assert len(rows) == len(incoming)
    return {r.id: (r.status, r.cross_role, r.anchor_id) for r in rows}


@pytest.mark.parametrize(("seed", "few"), [(1, 2048), (2, 3), (3, 1)])
def test_like_record_by_record(spark, seed, few):
    rng = random.Random(seed)
    matches = [f"M{k}" for k in range(40)] + [None]
    incoming, stored = items(rng, 500, "i", 4, matches), items(rng, 60, "e", 4, matches[:-1])
    assert found(spark, incoming, stored, few) == record_by_record(incoming, stored)


def test_one_long_match_key(spark):
    """A third of the rows share a match key that is longer than a piece, and alternate between the roles."""
    rng = random.Random(7)
    incoming = items(rng, 300, "i", 50, ["hot"], kinds=["footnote", "cross_reference", "paragraph"]) + items(rng, 300, "j", 3, [f"M{k}" for k in range(50)])
    stored = items(rng, 1, "e", 1, ["hot"])
    assert found(spark, incoming, stored, 16) == record_by_record(incoming, stored)


def test_a_row_hides_the_stored_one(spark):
    row = lambda i, role, kind, key, n, at=0: {"id": i, "logical_key": f"{role}|en|{key}", "match_key": "M", "language_code": "en", "resource_role": role, "content_type": kind, "content_hash": i, "sequence_no": n, "protection_level": "normal", "created_at": at}
    stored = [row("e1", "source_scripture", "footnote", "a", 0)]
    incoming = [row("i1", "footnotes", "paragraph", "b", 1), row("i2", "footnotes", "footnote", "c", 2), row("i3", "source_scripture", "footnote", "d", 3)]
    got = found(spark, incoming, stored, 2048)
    assert got == {"i1": ("new", False, None), "i2": ("new", False, None), "i3": ("conflict", True, "i2")}
    preview = {r.id: (r.status, r.anchor_id) for r in importing.classify(frame(spark, incoming), frame(spark, stored), within=False).collect()}
    assert preview == {"i1": ("new", None), "i2": ("conflict", "e1"), "i3": ("new", None)}


def test_nothing_comes_in(spark):
    assert found(spark, [], items(random.Random(1), 5, "e", 2, ["M"]), 2048) == {}
