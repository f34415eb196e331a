"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import conversation_repair, decontamination, jaccard_join, language_id, line_dedup, pieces, prefix_counts, sharding, substring_dedup, suffix_dedup, token_alignment, topk_search, toxicity
from vellum.llm.common import dealt_table, held_out, table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_decisions(dealt_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_kept", "n_removed", F.concat_ws(",", F.col("kept").cast("array<string>")).alias("kept"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(dealt_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_table(spark, sf_dir, "documents")
    guessed = language_id.predict(docs, language_id.train(docs))
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(dealt_table(spark, sf_dir, "documents"), model_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(dealt_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(dealt_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(dealt_table(spark, sf_dir, "documents"), model_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(dealt_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(dealt_table(spark, sf_dir, "documents"), model_path("byte_bpe_50k.json"), model_path())


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(dealt_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_line_dedup, op2_jaccard_join, op3_toxicity, op4_language_id, op5_topk_search, op6_sentencepiece, op7_decontamination, op8_suffix_dedup, op9_token_counts, op10_sharding, op11_token_alignment, op12_substring_dedup, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": """
            WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
            lines AS (SELECT doc_id, unnest(range(0, len(x))) AS nth, lower(trim(unnest(x), concat(' ', chr(9), chr(13)))) AS norm FROM split),
            firsts AS (SELECT row_number() OVER (ORDER BY norm) AS id, norm, doc_id, nth FROM (SELECT * FROM lines WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, nth) = 1)),
            sets AS (SELECT id, CASE WHEN length(norm) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5))) END AS s FROM firsts),
            each AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
            rare AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY c, g) AS k FROM each JOIN (SELECT g, count(*) AS c FROM each GROUP BY g) USING (g)),
            prefix AS (SELECT id, n, g FROM rare WHERE k <= n - ceil(0.8 * n) + 1),
            pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
            shared AS (SELECT a, b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS m FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b),
            links AS (SELECT a, b FROM shared WHERE m >= 0.8 * (total - m) - 1e-9),
            edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
            roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
            heads AS (SELECT doc_id, nth FROM firsts LEFT JOIN roots USING (id) QUALIFY row_number() OVER (PARTITION BY coalesce(root, id) ORDER BY doc_id, nth) = 1),
            kept AS (SELECT doc_id, count(*) AS k, string_agg(CAST(nth AS VARCHAR), ',' ORDER BY nth) AS kept FROM heads GROUP BY 1),
            counts AS (SELECT doc_id, count(*) FILTER (norm <> '') AS n FROM lines GROUP BY 1)
            SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k, 0) AS INTEGER) AS n_kept, CAST(coalesce(n, 0) - coalesce(k, 0) AS INTEGER) AS n_removed, coalesce(kept, '') AS kept
            FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
        "op2_jaccard_join": r"""
            WITH RECURSIVE words AS (
              SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
            ), sets AS (
              SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
            ), each AS (SELECT r, len(s) AS n, unnest(s) AS shingle FROM sets),
            links AS (
              SELECT a.r AS a, b.r AS b, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM each a JOIN each b ON a.shingle = b.shingle AND a.r <> b.r
              GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
            ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
            roots AS (SELECT reach.a AS r, min(s.doc_id) AS root FROM reach JOIN sets s ON s.r = reach.b GROUP BY 1),
            counts AS (SELECT a AS r, count(*) AS n_links, count(DISTINCT CASE WHEN shared < n OR shared < m THEN list_sort(s.s) END) AS n_text_links FROM links JOIN sets s ON s.r = links.b GROUP BY 1)
            SELECT doc_id, least(doc_id, coalesce(root, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, CAST(len(s) AS INTEGER) AS n_shingles
            FROM sets LEFT JOIN roots USING (r) LEFT JOIN counts USING (r)""",
        "op8_suffix_dedup": """
            WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            bases AS (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 256)) AS base FROM texts),
            parts AS (SELECT r, base, substr(h, CAST(2 * base + 1 AS BIGINT), 910) AS part FROM bases),
            starts AS (SELECT r, base, part, unnest(range(0, least(256, length(part) // 2 - 199))) AS k FROM parts),
            strings AS (SELECT r, base + k AS i, md5(substr(part, CAST(2 * k + 1 AS BIGINT), 400)) AS s FROM starts),
            repeated AS (SELECT r, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
            marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS first FROM repeated),
            numbered AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
            spans AS (SELECT r, span, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY 1, 2),
            gaps AS (
              SELECT r, lo AS until, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM spans
              UNION ALL SELECT r, (SELECT length(h) // 2 FROM texts t WHERE t.r = s.r), max(hi) FROM spans s GROUP BY r
            ), kept AS (SELECT r, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (until - since) AS BIGINT)), '' ORDER BY since) AS k FROM gaps JOIN texts USING (r) GROUP BY r),
            sums AS (SELECT r, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
            SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
            FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)""",
        "op12_substring_dedup": r"""
            WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            windows AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i : i + 12], ' ')))) AS k FROM texts),
            firsts AS (SELECT k, min(coalesce(doc_id, -9223372036854775808)) AS least FROM windows GROUP BY k),
            gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS at FROM windows JOIN firsts USING (k) WHERE least < coalesce(doc_id, -9223372036854775808)),
            words AS (SELECT r, unnest(range(1, len(w) + 1)) AS at, unnest(w) AS word FROM texts),
            kept AS (SELECT r, string_agg(word, ' ' ORDER BY at) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, at) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)""",
        "op5_topk_search": """
            WITH usable AS (
              SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), asked AS (SELECT DISTINCT vec_id, v FROM usable WHERE vec_id % 50 = 0),
            scored AS (
              SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id AS vec_id,
                     CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM asked q JOIN usable c ON q.vec_id <> c.vec_id
            ), ranked AS (
              SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    }
