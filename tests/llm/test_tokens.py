from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import pieces, prefix_counts
from vellum.llm.queries import model_path

PATH = model_path()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a", "a\n b", "x▁y", "▁", "▁▁a", "日本\U0001f600", "a\x00b", "\tq", "<s>a</s> <unk> <0x41>", "é ﬁ Ａ", "  a   b  ", "a" * 3000, " " * 200 + "x", "1234567 89", "ä̈"]
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \n▁theandioaäé1.,'"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = SP.encode(text)
    assert pieces.encode(PATH, text) == ids
    assert pieces.digest(PATH, text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest())
    assert pieces.decode(PATH, ids) == SP.decode(ids)
    assert prefix_counts.count(PATH, text) == len(ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_as_library(text):
    ids = SP.encode(text)
    assert pieces.encode(PATH, text) == ids
    assert pieces.decode(PATH, ids) == SP.decode(ids)
    assert list(prefix_counts.prefix_counts(PATH, text)) == [len(SP.encode(text[:i])) for i in range(len(text) + 1)]


def test_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MAX_KEPT", 3)
    for n in range(40):
        text = f"word{n} other{n % 5} again"
        assert pieces.encode(PATH, text) == SP.encode(text)
    assert len(pieces.code_table(PATH).kept) <= 6


def test_truncate():
    text = "Anhashsh erealy eaeron\nonatth  ouha"
    for budget in range(20):
        kept = prefix_counts.truncate(PATH, text, budget)
        longest = max(i for i in range(len(text) + 1) if len(SP.encode(text[:i])) <= budget)
        assert len(kept) == longest


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a  b\n c", None), (3, "a  b\n c", None), (None, "z", "q")], "doc_id long, text string, ids string")
    rows = pieces.encoding_digests(docs, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(SP.encode(t or "")) for t in (None, "", "a  b\n c", "a  b\n c", "z"))
    counts = prefix_counts.token_counts(docs, PATH, limit=2).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((len((t or "").encode()), n := len(SP.encode(t or "")), n > 2) for t in (None, "", "a  b\n c", "a  b\n c", "z"))
    assert pieces.encoding_digests(docs.limit(0), PATH).count() == 0 == prefix_counts.token_counts(docs.limit(0), PATH).count()
    assert {r.doc_id: r.ids for r in pieces.encode_documents(docs, PATH).collect()}[2] == []


def test_texts_of_a_batch_share_a_call(monkeypatch):
    """A call of the library starts threads, so new chunks of many texts go into one."""
    texts = [f"firstly{k} new{k}ly words of text{k}\n\n x▁{k}" for k in range(50)] + [None, "", " ", *ODD]
    calls, table = [], pieces.code_table(PATH)
    make = table.make
    monkeypatch.setattr(table, "make", lambda new: calls.append(len(new)) or make(new))
    for most, least in ((pieces.TOGETHER, 1), (10, 20)):
        monkeypatch.setattr(pieces, "TOGETHER", most)
        table.kept.clear(), calls.clear()
        want = [SP.encode(t or "") for t in texts]
        got = list(pieces.digests(PATH, texts))
        assert got == [(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(SP.decode(i).encode() if i else b"").hexdigest()) for i in want]
        assert len(calls) == 1 if least == 1 else len(calls) >= least
