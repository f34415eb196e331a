"""Identities with more records than the evidence names."""

from __future__ import annotations

import hashlib
import json
import random

import pytest

from vellum import dims
from vellum.operators import quality

ITEM = "id string, resource_role string, language_code string, language_role string, match_key string, semantic_key string, logical_key string, book_code string, chapter int, sequence_no int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(f"i{k:04}", "notes", "en", None, rng.choice(["hot", "hot", f"m{k % 90}"]), "s", "l", rng.choice(["MAT", "GEN"]), rng.randrange(9), rng.randrange(500)) for k in range(400)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("evidence", [1000, 50, 3, 1])
def test_bounded_evidence(spark, rows, evidence):
    items = spark.createDataFrame(rows, ITEM)
    groups = {}
    for r in rows:
        groups.setdefault(f"notes|en|{r[4]}", []).append(r)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    want = {}
    for key, members in groups.items():
        ordered = [m[0] for m in sorted(members, key=lambda m: (m[7], m[8], m[9], m[0]))]
        fingerprint = hashlib.sha256(f"{dims.ENGINE}|duplicate_match|{key}|{','.join(sorted(ordered))}".encode()).hexdigest()
        shown = {"matchIdentity": key, "recordIds": ordered[:evidence], "resourceRoles": ["notes"] * min(len(ordered), evidence)}
        want[fingerprint] = (ordered[0], shown | ({"records": len(ordered)} if len(ordered) > evidence else {}))
    got = {r.fingerprint: (r.content_item_id, json.loads(r.evidence)) for r in quality.duplicate_findings(items, evidence).collect()}
    assert got == want and len(want) > 20
    assert quality.duplicate_members(items).count() == sum(map(len, groups.values()))
