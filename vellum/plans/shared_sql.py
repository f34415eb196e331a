"""SQL that Spark and DuckDB read alike: views over the driver's tables in the shape of canonical items.

The raw tables hold no defects, so defects are injected by fixed rules on the keys, the same for the
query and for its check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Conversations as bilingual items: a user's turn is the source, the assistant's the target.
ITEMS = """
  SELECT id, book_code, chapter, verse, content_type, marker, sequence_no, semantic_key, match_key,
         concat_ws('|', resource_role, language_code, semantic_key) AS logical_key,
         language_code, language_role, resource_role,
         CASE WHEN content_type = 'scripture' THEN 'protected_scripture' ELSE 'normal' END AS protection_level,
         CASE WHEN sequence_no % 4 = 0 THEN 'approved' ELSE 'unreviewed' END AS review_status,
         current_text,
         concat(current_text, CASE
           WHEN conv_id % 6 = 1 THEN concat(' ', chr(92), 'f + note', chr(92), 'f*')
           WHEN conv_id % 6 = 2 THEN concat(' ', chr(92), 'f + note')
           WHEN conv_id % 6 = 3 THEN concat(' ', chr(92), 'x - a', chr(92), 'x* ', chr(92), ' fq bad')
           WHEN conv_id % 6 = 4 AND language_role = 'source' THEN concat(' ', chr(92), 'fq a', chr(92), 'fq*')
           WHEN conv_id % 6 = 4 THEN concat(' ', chr(92), 'FQ a')
           ELSE '' END) AS raw_text,
         concat('turn:', CAST(turn AS STRING)) AS source_locator
  FROM (
    SELECT conv_id, turn, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id,
           CASE conv_id % 4 WHEN 0 THEN 'MAT' WHEN 1 THEN 'MRK' WHEN 2 THEN 'PSA' ELSE 'GEN' END AS book_code,
           CAST(conv_id % 40 AS INT) AS chapter,
           CAST(CAST(floor(turn / 2) AS INT) AS STRING) AS verse,
           CASE conv_id % 5 WHEN 0 THEN 'scripture' WHEN 1 THEN 'footnote' WHEN 2 THEN 'study_note' WHEN 3 THEN 'section_heading' ELSE 'other' END AS content_type,
           CASE WHEN conv_id % 5 = 0 THEN 'v' ELSE 's' END AS marker,
           CAST(conv_id * 8 + turn AS INT) AS sequence_no,
           concat('C|', CAST(conv_id AS STRING), '|', CAST(CAST(floor(turn / 2) AS INT) AS STRING)) AS semantic_key,
           concat('M|', CAST(CASE WHEN conv_id % 9 = 0 THEN conv_id % 2 ELSE conv_id END AS STRING), '|', CAST(CAST(floor(turn / 2) AS INT) AS STRING)) AS match_key,
           CASE WHEN role = 'user' THEN 'en' ELSE 'ta' END AS language_code,
           CASE WHEN role = 'user' THEN 'source' ELSE 'target' END AS language_role,
           CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN 'source_scripture' WHEN conv_id % 5 = 0 THEN 'target_scripture' ELSE 'study_notes' END AS resource_role,
           CASE WHEN conv_id % 13 = 3 AND role <> 'user' THEN ' ' ELSE concat(text,
             CASE WHEN conv_id % 3 = 0 OR role = 'user' THEN concat(' 3:', CAST(CAST(floor(turn / 2) AS INT) AS STRING), ' 1/4') ELSE concat(' 1 / 4 3 : ', CAST(turn AS STRING)) END,
             CASE WHEN conv_id % 7 = 0 THEN ' cafe\u0301' ELSE '' END,
             CASE WHEN conv_id % 11 = 0 THEN ' zero\u200b\u2060width' ELSE '' END,
             CASE WHEN conv_id % 17 = 0 THEN ' \ufffd' ELSE '' END,
             CASE WHEN conv_id % 19 = 0 THEN chr(1) ELSE '' END) END AS current_text
    FROM conversations WHERE role <> 'system') AS raw_items"""

_DOCS = """
    SELECT doc_id, CAST(floor(doc_id / 4) AS INT) AS k, text FROM documents WHERE doc_id % 4 {part}"""

_IMPORT = """
  SELECT concat('d', CAST(doc_id AS STRING)) AS id, CAST(doc_id AS INT) AS sequence_no, 'en' AS language_code, content_type, resource_role, semantic_key, match_key,
         concat_ws('|', resource_role, 'en', semantic_key) AS logical_key,
         CASE WHEN content_type = 'scripture' THEN 'protected_scripture' ELSE 'normal' END AS protection_level,
         'unreviewed' AS review_status, current_text, current_text AS raw_text, doc_id AS created_at
  FROM (
    SELECT doc_id,
           {kind} AS content_type,
           {role} AS resource_role, {key} AS semantic_key, concat('M|', CAST(k AS STRING)) AS match_key,
           {text} AS current_text
    FROM ({docs}) AS d) AS shaped"""

_OWN = "CASE k % 5 WHEN 0 THEN 'footnotes' WHEN 1 THEN 'cross_references' WHEN 2 THEN 'study_notes' WHEN 3 THEN 'source_scripture' ELSE 'maps_charts' END"
_KIND = "CASE k % 5 WHEN 0 THEN 'footnote' WHEN 1 THEN 'cross_reference' WHEN 2 THEN 'section_heading' WHEN 3 THEN 'scripture' ELSE 'figure' END"
#: Some incoming rows have a key of their own and are inserted, and hide the stored row of their match key from those that follow.
_MASKS = "k % 11 = 4 AND doc_id % 4 = 1"
EXISTING = _IMPORT.format(kind=_KIND, role=f"CASE WHEN k % 3 = 0 THEN {_OWN} WHEN k % 3 = 1 THEN 'source_scripture' ELSE 'target_scripture' END", key="concat('S|', CAST(k AS STRING))", text="CASE WHEN k % 4 = 0 THEN 'same text' ELSE text END", docs=_DOCS.format(part="= 0"))
INCOMING = _IMPORT.format(kind=f"CASE WHEN {_MASKS} THEN 'paragraph' ELSE {_KIND} END", role=f"CASE WHEN doc_id % 4 = 1 OR k % 2 = 0 THEN {_OWN} ELSE 'source_scripture' END", key=f"CASE WHEN {_MASKS} THEN concat('U|', CAST(k AS STRING)) WHEN k % 7 = 0 THEN concat('T|', CAST(k AS STRING)) ELSE concat('S|', CAST(k AS STRING)) END", text="CASE WHEN k % 4 = 0 AND doc_id % 4 < 3 THEN ' same  text ' ELSE text END", docs=_DOCS.format(part="<> 0"))

#: Further columns of the two sides: files, resources, places, roles.
INCOMING_MORE = """concat('f', CAST(sequence_no % 7 AS STRING)) AS file_id, concat('r', CAST(sequence_no % 7 AS STRING)) AS resource_id, concat('row:', CAST(sequence_no AS STRING)) AS source_locator,
  CASE WHEN sequence_no % 7 = 0 AND sequence_no % 2 = 0 THEN 'source' WHEN sequence_no % 7 = 0 THEN 'target' WHEN sequence_no % 7 = 1 THEN 'source' END AS language_role,
  CASE WHEN sequence_no % 7 = 2 THEN 'MAT' WHEN sequence_no % 7 < 5 AND sequence_no % 2 = 0 THEN 'GEN' WHEN sequence_no % 7 < 5 THEN 'EXO' END AS book_code"""
EXISTING_MORE = """concat('n', CAST(sequence_no % 25 AS STRING)) AS resource_id, CAST(NULL AS STRING) AS source_locator, CASE WHEN sequence_no % 3 = 0 THEN 'f' ELSE 's' END AS marker,
  CASE WHEN sequence_no % 8 = 0 THEN 'MAT' ELSE 'GEN' END AS book_code, CAST(sequence_no % 28 AS INT) AS chapter, CAST(NULL AS STRING) AS verse"""

#: File names of all kinds, one for each supplier.
FILE_NAMES = """
  SELECT s_suppkey, concat(s_name, ' ', CASE s_suppkey % 11 WHEN 0 THEN 'Reference-Notes.csv' WHEN 1 THEN 'My FOOTnotes.csv' WHEN 2 THEN 'back matter.docx' WHEN 3 THEN 'Glossary.tsv' WHEN 4 THEN 'Maps.json' WHEN 5 THEN 'sub-heading.csv'
    WHEN 6 THEN 'GSB.sfm' WHEN 7 THEN 'gsb.csv' WHEN 8 THEN 'IRV.USFM' WHEN 9 THEN 'tam notes.usfm' ELSE 'plain note.usfm' END) AS filename FROM supplier"""

#: Documents as single-language items, with decomposed letters and zero-width characters added.
DOCUMENTS = """
  SELECT concat('d', CAST(doc_id AS STRING)) AS id, doc_id, lang AS language_code, source AS resource_role,
         CASE doc_id % 6 WHEN 0 THEN 'scripture' WHEN 1 THEN 'footnote' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'paragraph' ELSE 'poetry' END AS content_type,
         CASE WHEN doc_id % 6 = 0 THEN 'protected_scripture' ELSE 'normal' END AS protection_level,
         CASE WHEN doc_id % 5 = 0 THEN 'approved' ELSE 'unreviewed' END AS review_status,
         CASE WHEN doc_id % 10 = 7 THEN NULL ELSE concat('B', CAST(doc_id % 10 AS STRING)) END AS book_code,
         CASE WHEN doc_id % 12 = 5 THEN NULL ELSE CAST(doc_id % 12 AS INT) END AS chapter, CAST(doc_id AS INT) AS sequence_no,
         concat(text, CASE WHEN doc_id % 7 = 0 THEN ' cafe\u0301' WHEN doc_id % 11 = 0 THEN ' zero\u200b\u2060width' ELSE '' END) AS current_text
  FROM documents"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The DataFrame of shared SQL over tables of sf_dir, without registering names in the session."""
    return spark.sql(_bound(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _bound(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return sql
