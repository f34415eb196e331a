"""A null doc_id and ids beyond 2^53 in one batch."""

from __future__ import annotations

import pytest

from vellum.llm import conversation_repair, decontamination, jaccard_join, language_id, line_dedup, pieces, prefix_counts, sharding, substring_dedup, suffix_dedup, token_alignment, toxicity
from vellum.llm.queries import model_path

IDS = [2**53 + 1, None, -(2**62) - 1, 7, 2**63 - 1]


def _toxicity(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    learn = spark.createDataFrame([(k, "bad words here" if k % 2 else "good text there") for k in range(40)], "doc_id long, text string")
    return toxicity.score(docs, toxicity.train(learn, labels))


def _language(spark, docs):
    learn = spark.createDataFrame([(k, "ab cd", "x") if k % 2 else (k, "yz wv", "y") for k in range(40)], "doc_id long, text string, lang string")
    return language_id.predict(docs, language_id.train(learn))


def _benchmark(spark):
    return spark.createDataFrame([(1, "a question of some words here ? and an answer of others .")], "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda spark, docs: line_dedup.line_decisions(docs),
    "jaccard_join": lambda spark, docs: jaccard_join.join_classes(docs),
    "toxicity": _toxicity,
    "language_id": _language,
    "sentencepiece": lambda spark, docs: pieces.encoding_digests(docs, model_path()),
    "encode": lambda spark, docs: pieces.encode_documents(docs, model_path()),
    "decontamination": lambda spark, docs: decontamination.find_leaks(docs, _benchmark(spark)),
    "suffix_dedup": lambda spark, docs: suffix_dedup.repeat_digests(docs),
    "token_counts": lambda spark, docs: prefix_counts.token_counts(docs, model_path()),
    "truncate": lambda spark, docs: prefix_counts.truncate_documents(docs, model_path(), 5),
    "sharding": lambda spark, docs: sharding.shard_by_bytes(docs),
    "token_alignment": lambda spark, docs: token_alignment.alignment_digests(docs, model_path("byte_bpe_50k.json"), model_path()),
    "substring_dedup": lambda spark, docs: substring_dedup.repeat_digests(docs),
    "conversation_repair": lambda spark, docs: conversation_repair.damage_and_repair(docs.selectExpr("doc_id AS conv_id", "doc_id AS turn", "'user' AS role", "text")).withColumnRenamed("conv_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back_as_they_are(spark, name):
    docs = spark.createDataFrame([(i, f"text number {k} of a batch") for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)
    rows = OPERATORS[name](spark, docs)
    assert dict(rows.dtypes)["doc_id"] == "bigint"
    assert sorted(r.doc_id for r in rows.collect() if r.doc_id is not None) == sorted(i for i in IDS if i is not None)
    assert sum(r.doc_id is None for r in rows.collect()) == 1
