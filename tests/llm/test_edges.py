"""Very long texts, repeated rows and ties, for operators whose own tests have none of them."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import common, language_id, sharding, toxicity


def _docs(spark):
    rng = np.random.default_rng(31)
    word = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, word("abcde" if i % 2 else "vwxyz", 20) + (" vilescum" if i % 5 == 0 else ""), "aa" if i % 2 else "zz") for i in range(200)]
    rows += [(300, word("abcde", 60_000) + " vilescum" * 4000, "aa"), (301, word("vwxyz", 60_000), "zz")]
    rows += [rows[7], rows[7], rows[10]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")


def test_classifiers_on_long_texts_and_repeated_rows(spark):
    docs, labels = _docs(spark)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    by = {r.doc_id: r for r in scored}
    assert len(scored) == docs.count() and by[300].predicted == 1 and by[301].predicted == 0
    assert len({(r.score, r.predicted) for r in scored if r.doc_id == 7}) == 1 == by[10].predicted
    guessed = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(guessed) == len(scored) and {(r.doc_id, r.lang_pred) for r in guessed if r.doc_id in (7, 300, 301)} == {(7, "aa"), (300, "aa"), (301, "zz")}


def test_shards_with_a_document_larger_than_a_shard_and_ties(spark):
    docs = spark.createDataFrame([(5, "same")] * 40 + [(6, "same")] * 40 + [(1, "x" * 100_000)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert len(got) == 81
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_pipeline_with_repeated_rows_and_a_long_text(spark, tmp_path):
    docs, labels = _docs(spark)
    docs.selectExpr("doc_id", "text", "lang", "'s' AS source", "0L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "0 AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is here. not at all so.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == [i for i in range(200) if i % 5] + [301]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        sparkContext, conf = Context, Conf  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)
