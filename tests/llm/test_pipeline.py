from __future__ import annotations

import numpy as np
import sentencepiece

import corpus_pipeline
from vellum.llm.queries import model_path


def _tables(spark, folder):
    rng = np.random.default_rng(11)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghijkl"), rng.integers(3, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(150):
        toxic = i % 6 == 0
        lines = [word(30) for _ in range(3)]
        if toxic:
            lines[1] += " vilescum vilescum trash"
        docs.append([i, "\n".join(lines), "en", "s", 0])
        labels.append((i, 0, int(toxic)))
    passage = [(1, word(12) + ". " + word(14) + ".")]
    copies = {200: docs[1][1], 203: docs[2][1].replace("\n", " ")}
    for i, t in copies.items():
        docs.append([i, t, "en", "s", 0])
    docs.append([210, word(40) + "\n" + word(5) + " " + passage[0][1] + " " + word(5), "en", "s", 0])
    docs.append([211, None, None, None, None])
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(passage, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    docs = _tables(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i in range(150) if i % 6 == 0}
    # 200 has no line left; 203 joins the lines of 2 into one, and is its near copy; 210 holds the passage
    assert set(got) == {d[0] for d in docs} - toxic - {200, 203, 210}
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all(got[d[0]].n_tokens == len(sp.encode(d[1] or "")) for d in docs if d[0] in got)


def test_stages_keep_the_columns(spark, tmp_path):
    _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
