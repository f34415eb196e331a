"""DuckDB SQL for every registered query that SQL can express."""

from __future__ import annotations

from vellum import dims
from vellum.operators.importing import REASONS
from vellum.operators.quality import MESSAGES
from vellum.plans.shared_sql import DOCUMENTS, EXISTING, EXISTING_MORE, FILE_NAMES, INCOMING, INCOMING_MORE, ITEMS

_W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ZW = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _norm(x: str) -> str:
    return _trim(f"regexp_replace(regexp_replace(nfc_normalize({x}), '{_ZW}', '', 'g'), '{_W}+', ' ', 'g')")


def _numbers(x: str) -> str:
    dashes = f"regexp_replace(coalesce({x}, ''), '[‐‑‒–—−]', '-', 'g')"
    tight = f"regexp_replace({dashes}, '{_W}*([:/\\-]){_W}*', '\\1', 'g')"
    return f"regexp_extract_all({tight}, '[0-9]+/[0-9]+|[0-9]+(?::[0-9]+)?(?:-[0-9]+(?::[0-9]+)?)?')"


def _markers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\\\[A-Za-z][A-Za-z0-9]*\\*?'), lambda m: lower(substr(m, 2)))"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _fp(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join([f"'{dims.ENGINE}'", *parts]) + "))"


def _told(template: str, *values: str) -> str:
    said = "'" + template.replace("'", "''") + "'"
    for k, v in enumerate(values):
        said = f"replace({said}, '{{{k}}}', {v})"
    return said


def _issue(source: str, where: str, category: str, severity: str, confidence: float, *parts: str, item: str = "id", paired: str = "CAST(NULL AS VARCHAR)", message: str = "", **evidence: str) -> str:
    shown = "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in evidence.items()) + ") AS VARCHAR)"
    return f"""SELECT {item} AS content_item_id, {paired} AS paired_content_item_id, '{category}' AS category, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence, {_fp(*parts)} AS fingerprint,
        {message or _told(MESSAGES[category])} AS message, {shown} AS evidence FROM {source} WHERE {where}"""


def _issues_cte() -> str:
    counts = lambda m: (f"len(regexp_extract_all(raw_text, '\\\\{m}(?:{_W}|\\+|$)'))", f"len(regexp_extract_all(raw_text, '\\\\{m}\\*'))")
    (fa, fb), (xa, xb) = counts("f"), counts("x")
    both, at = "sid IS NOT NULL AND tid IS NOT NULL", {"sourceLocator": "source_locator"}
    side = "CASE WHEN sid IS NOT NULL THEN 'source_only' ELSE 'target_only' END"
    union = "\n      UNION ALL ".join(
        [
            _issue("items", r"regexp_matches(current_text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]')", "unicode_zero_width", "medium", 1.0, "'zero_width'", "id", **at,
                   characters=r"list_transform(regexp_extract_all(current_text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]'), lambda x: concat('U+', to_hex(unicode(x))))"),
            _issue("items", "contains(current_text, '�')", "unicode_replacement_character", "high", 1.0, "'replacement'", "id", **at),
            _issue("items", r"regexp_matches(current_text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')", "invalid_control_character", "high", 1.0, "'control'", "id", **at),
            _issue("items", "nfc_normalize(current_text) <> current_text", "unicode_normalization", "low", 1.0, "'nfc'", "id", **at),
            _issue("items", rf"regexp_matches(raw_text, '\\{_W}+[A-Za-z][A-Za-z0-9]*|\\[A-Za-z][A-Za-z0-9]*{_W}+\*')", "usfm_marker_spacing", "high", 0.99, "'marker_spacing'", "id", **at, rawText="raw_text"),
            _issue("items", f"{fa} <> {fb}", "usfm_marker_balance", "high", 1.0, "'marker_balance'", "'f'", "id", fa, fb, message=_told(MESSAGES["usfm_marker_balance"], "'f'"), **at, startCount=fa, endCount=fb, rawText="raw_text"),
            _issue("items", f"{xa} <> {xb}", "usfm_marker_balance", "high", 1.0, "'marker_balance'", "'x'", "id", xa, xb, message=_told(MESSAGES["usfm_marker_balance"], "'x'"), **at, startCount=xa, endCount=xb, rawText="raw_text"),
            _issue("items JOIN books USING (book_code)", "chapter < 1 OR chapter > max_chapter", "invalid_chapter_anchor", "critical", 1.0, "'chapter_range'", "id",
                   message=_told(MESSAGES["invalid_chapter_anchor"], "CAST(chapter AS VARCHAR)", "book_code", "CAST(max_chapter AS VARCHAR)"), bookCode="book_code", chapter="chapter", maxChapter="max_chapter"),
            _issue("pairs", f"{both} AND list_sort(sn) <> list_sort(tn)", "number_mismatch", "high", 0.98, "'numbers'", "key", "array_to_string(sn, ',')", "array_to_string(tn, ',')", item="tid", paired="sid",
                   sourceNumbers="sn", targetNumbers="tn", sourceText="stext", targetText="ttext", protectedScripture="ttype = 'scripture'"),
            _issue("pairs", f"{both} AND stype IN {_in(dims.TRANSLATED_TYPES)} AND {_trim('stext')} <> '' AND {_trim('ttext')} = ''", "empty_target_content", "high", 1.0, "'empty_target'", "key", item="tid", paired="sid",
                   sourceText="stext", sourceLocator="sat", targetLocator="tat"),
            _issue("pairs", f"{both} AND stype <> 'scripture' AND ttype <> 'scripture' AND srole = trole AND srole NOT IN ('source_scripture', 'target_scripture') AND sm <> tm", "usfm_marker_sequence_mismatch", "medium", 0.98,
                   "'marker_seq'", "key", "array_to_string(sm, ',')", "array_to_string(tm, ',')", item="tid", paired="sid", sourceMarkers="sm", targetMarkers="tm", sourceRaw="sraw", targetRaw="traw"),
            _issue("pairs", "(sid IS NULL OR tid IS NULL) AND coalesce(stype, ttype) = 'scripture'", "versification_difference", "info", 1.0, "'versification'", "key", side, item="coalesce(tid, sid)",
                   message=f"CASE WHEN sid IS NOT NULL THEN {_told(MESSAGES['source_only'])} ELSE {_told(MESSAGES['target_only'])} END", semanticKey="key", side=side, book="book", chapter="chapter", verse="verse"),
            _issue("dups", "n > 1", "duplicate_canonical_record", "high", 1.0, "'duplicate_match'", "key", "ids", item="first_id", matchIdentity="key", recordIds="ordered", resourceRoles="roles"),
        ]
    )
    return f"""items AS ({ITEMS}), books(book_code, max_chapter) AS (VALUES {_values(dims.CHAPTERS.items())}),
    src AS (SELECT * FROM items WHERE language_role = 'source'), tgt AS (SELECT * FROM items WHERE language_role = 'target'),
    pairs AS (
      SELECT coalesce(s.semantic_key, t.semantic_key) AS key, s.id AS sid, t.id AS tid, s.content_type AS stype, t.content_type AS ttype, s.resource_role AS srole, t.resource_role AS trole, s.raw_text AS sraw, t.raw_text AS traw,
             s.source_locator AS sat, t.source_locator AS tat, coalesce(s.book_code, t.book_code) AS book, coalesce(s.chapter, t.chapter) AS chapter, coalesce(s.verse, t.verse) AS verse, s.current_text AS stext, t.current_text AS ttext, {_numbers("s.current_text")} AS sn, {_numbers("t.current_text")} AS tn, {_markers("s.raw_text")} AS sm, {_markers("t.raw_text")} AS tm
      FROM src s FULL JOIN tgt t ON s.semantic_key = t.semantic_key),
    dups AS (
      SELECT concat_ws('|', resource_role, language_code, match_key) AS key, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids,
             first(id ORDER BY book_code, chapter, sequence_no, id) AS first_id, list(id ORDER BY book_code, chapter, sequence_no, id) AS ordered, list(resource_role ORDER BY book_code, chapter, sequence_no, id) AS roles
      FROM items GROUP BY 1),
    issues AS ({union})"""


_ANCHOR = "STRUCT(key VARCHAR, id VARCHAR, hash VARCHAR, role VARCHAR, protection VARCHAR)"


def _stands_in(kind: str, mine: str, other: str) -> str:
    inside = "('source_scripture', 'target_scripture')"
    own = f"CASE {kind} WHEN 'footnote' THEN 'footnotes' WHEN 'cross_reference' THEN 'cross_references' WHEN 'section_heading' THEN 'study_notes' END"
    return f"coalesce(({mine} = {own} AND {other} IN {inside}) OR ({other} = {own} AND {mine} IN {inside}), false)"


def _classified(within: bool) -> str:
    """One incoming row after the other: step n looks at the n-th row of every match key, with the rows inserted before.  Needs WITH RECURSIVE."""
    told = lambda p: f"{{'key': {p}.logical_key, 'id': {p}.id, 'hash': {p}.content_hash, 'role': {p}.resource_role, 'protection': {p}.protection_level}}"
    earlier = "list_filter(s.inserted, lambda x: x.key = p.logical_key)[1]" if within else "NULL"
    newest = "coalesce(s.inserted[len(s.inserted)], p.near)" if within else "p.near"
    return f"""authority(content_type, resource_role, priority) AS (VALUES {_values(dims.AUTHORITY)}),
    stored AS (SELECT *, {EXISTING_MORE}, sha256({_norm("current_text")}) AS content_hash FROM ({EXISTING})),
    incoming AS (SELECT *, {INCOMING_MORE}, sha256({_norm("current_text")}) AS content_hash FROM ({INCOMING})),
    same AS (SELECT logical_key, {told("stored")} AS same FROM stored QUALIFY row_number() OVER (PARTITION BY logical_key ORDER BY id) = 1),
    newest AS (SELECT match_key, language_code, {told("stored")} AS near FROM stored QUALIFY row_number() OVER (PARTITION BY match_key, language_code ORDER BY created_at DESC, id DESC) = 1),
    probed AS (
      SELECT i.*, s.same, n.near, row_number() OVER (PARTITION BY i.match_key, i.language_code ORDER BY i.sequence_no, i.id) AS nth
      FROM incoming i LEFT JOIN same s ON s.logical_key = i.logical_key LEFT JOIN newest n ON n.match_key = i.match_key AND n.language_code = i.language_code),
    steps(match_key, nth, inserted, id, anchor, cross_role) AS (
      SELECT DISTINCT match_key, CAST(0 AS BIGINT), CAST([] AS {_ANCHOR}[]), CAST(NULL AS VARCHAR), CAST(NULL AS {_ANCHOR}), false FROM incoming
      UNION ALL
      SELECT match_key, nth, CASE WHEN anchor IS NULL THEN list_append(inserted, own) ELSE inserted END, id, anchor, by_key IS NULL AND anchor IS NOT NULL
      FROM (
        SELECT *, CASE WHEN by_key IS NOT NULL THEN by_key WHEN candidate IS NOT NULL AND content_type IN {_in(dims.MATCHED_TYPES)} AND candidate.role <> resource_role AND {_stands_in("content_type", "resource_role", "candidate.role")} THEN candidate END AS anchor
        FROM (SELECT p.match_key, p.nth, s.inserted, p.id, p.content_type, p.resource_role, {told("p")} AS own, coalesce(p.same, {earlier}) AS by_key, {newest} AS candidate
              FROM steps s JOIN probed p ON p.match_key = s.match_key AND p.nth = s.nth + 1))),
    anchored AS (
      SELECT p.*, s.cross_role, s.anchor.id AS anchor_id, s.anchor.hash AS anchor_hash, s.anchor.role AS old_role, s.anchor.protection AS old_protection
      FROM probed p JOIN steps s ON s.id = p.id),
    ranked AS (
      SELECT a.*, CASE WHEN anchor_id IS NULL THEN 'new' WHEN anchor_hash = content_hash THEN 'identical' ELSE 'conflict' END AS status, coalesce(o.priority, 0) AS old_p, coalesce(w.priority, 0) AS new_p
      FROM anchored a LEFT JOIN authority o ON o.content_type = a.content_type AND o.resource_role = a.old_role LEFT JOIN authority w ON w.content_type = a.content_type AND w.resource_role = a.resource_role),
    classified AS (
      SELECT id, logical_key, match_key, sequence_no, created_at, file_id, resource_id, source_locator, content_type, resource_role, status, cross_role, anchor_id, old_role, current_text, raw_text, old_protection = 'protected_scripture' AS protected,
             CASE WHEN status <> 'conflict' THEN NULL
                  WHEN old_protection = 'protected_scripture' OR content_type IN ('scripture', 'scripture_fragment') THEN {_told(REASONS["scripture"])}
                  WHEN new_p > old_p THEN {_told(REASONS["use_incoming"], "resource_role", "CAST(new_p AS VARCHAR)", "CAST(old_p AS VARCHAR)")}
                  WHEN new_p < old_p THEN {_told(REASONS["keep_existing"], "old_role", "CAST(old_p AS VARCHAR)", "CAST(new_p AS VARCHAR)")} ELSE {_told(REASONS["manual_review"])} END AS reason,
             CASE WHEN status <> 'conflict' THEN NULL
                  WHEN old_protection = 'protected_scripture' OR content_type IN ('scripture', 'scripture_fragment') THEN 'manual_review'
                  WHEN new_p > old_p THEN 'use_incoming' WHEN new_p < old_p THEN 'keep_existing' ELSE 'manual_review' END AS recommendation
      FROM ranked)"""


_DECIDED = """decided AS (
              SELECT sha256(concat(c.id, '|', anchor_id)) AS conflict_id, anchor_id, c.resource_id, c.source_locator, CASE WHEN recommendation = 'manual_review' THEN concat('merged ', c.id) ELSE c.current_text END AS new_text
              FROM classified c JOIN stored s ON s.id = anchor_id
              WHERE status = 'conflict' AND recommendation <> 'keep_existing' AND c.content_type <> 'figure' AND (s.protection_level <> 'protected_scripture' OR length(c.current_text) % 2 = 0)),
            last AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY conflict_id DESC) = 1)"""

_FILES = """files AS (SELECT concat('f', i) AS file_id, concat('b', i % 3) AS batch_id, concat('file ', i) AS filename, CASE WHEN i % 4 < 3 THEN 'en' END AS language_code, 'notes' AS resource_role FROM range(8) t(i))"""

_CANON = {"semanticKey": "semantic_key", "matchKey": "match_key", "bookCode": "book_code", "chapter": "CAST(chapter AS VARCHAR)", "verse": "verse", "contentType": "content_type", "marker": "marker",
          "sequenceNo": "CAST(sequence_no AS VARCHAR)", "languageCode": "language_code", "languageRole": "language_role", "protectionLevel": "protection_level", "reviewStatus": "review_status",
          "currentText": "current_text", "rawText": "raw_text", "sourceLocator": "source_locator", "resourceRole": "resource_role"}


def _cell(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '["\\r\\n,]') THEN concat('"', replace({x}, '"', '""'), '"') ELSE {x} END"""


def all_sql() -> dict[str, str]:
    return {name: sql.replace("WITH ", "WITH RECURSIVE ", 1) if "steps(" in sql else sql for name, sql in _plain_sql().items()}


def _plain_sql() -> dict[str, str]:
    issues, docs = _issues_cte(), f"docs AS ({DOCUMENTS})"
    issue_columns = "content_item_id, paired_content_item_id, category, severity, confidence, fingerprint"
    protected = "CAST(sum(CASE WHEN protection_level = 'protected_scripture' THEN 1 ELSE 0 END) AS BIGINT)"
    age, nth = "CAST(concat('0x', substr(fingerprint, 1, 6)) AS INTEGER)", "CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER)"
    severity_rank = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(dims.SEVERITIES, 1)) + " END"
    rules = {name: f"WITH {issues} SELECT {issue_columns} FROM issues WHERE category IN {_in(found)}" for name, found in _categories().items()}
    csv = {"semanticKey": "id", "matchKey": "id", "bookCode": "coalesce(book_code, '')", "chapter": "coalesce(CAST(chapter AS VARCHAR), '')", "contentType": "content_type", "sequenceNo": "CAST(sequence_no AS VARCHAR)",
           "languageCode": "language_code", "protectionLevel": "protection_level", "reviewStatus": "review_status", "currentText": "current_text", "rawText": "concat('say \"so\", or', chr(10), 'not')", "resourceRole": "resource_role"}
    return rules | {
        "normalize_hash": f"WITH {docs}, n AS (SELECT doc_id, {_norm('current_text')} AS norm FROM docs) SELECT doc_id, CAST(length(norm) AS INTEGER) AS n, sha256(norm) AS content_hash FROM n",
        "duplicate_identity": f"SELECT sha256({_norm('text')}) AS content_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "exact_dup_probe": """WITH f AS (SELECT doc_id, sha256(text) AS sha256, CASE WHEN lang <> 'fr' THEN lang END AS language_code FROM documents)
            SELECT a.doc_id, a.sha256, a.language_code FROM f a WHERE a.doc_id % 2 = 1 AND NOT EXISTS (
              SELECT 1 FROM f b WHERE b.doc_id % 2 = 0 AND b.sha256 = a.sha256 AND coalesce(b.language_code, '') = coalesce(a.language_code, ''))""",
        "stats_totals": f"WITH {docs} SELECT count(*) AS items, {protected} AS protected, CAST(sum(CASE WHEN review_status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved FROM docs",
        "stats_by_type": f"WITH {docs} SELECT content_type, count(*) AS n FROM docs GROUP BY 1",
        "project_counts": """SELECT n_nationkey AS project_id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS book_count,
            (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS item_count FROM nation""",
        "book_summary": f"""WITH {docs}, books AS (SELECT concat('B', CAST(i AS VARCHAR)) AS book_code FROM range(12) t(i))
            SELECT b.book_code, count(d.id) AS item_count, count(DISTINCT d.chapter) AS chapter_count, CAST(sum(CASE WHEN d.protection_level = 'protected_scripture' THEN 1 ELSE 0 END) AS BIGINT) AS scripture_count
            FROM books b LEFT JOIN docs d ON d.book_code = b.book_code GROUP BY 1""",
        "chapter_summary": f"WITH {docs} SELECT book_code, chapter, count(*) AS item_count, {protected} AS scripture_count FROM docs WHERE chapter IS NOT NULL GROUP BY 1, 2",
        "browse_page": f"""WITH {docs}, page AS (SELECT * FROM docs ORDER BY book_code NULLS FIRST, chapter NULLS FIRST, sequence_no, id LIMIT 300 OFFSET 300)
            SELECT p.id, p.book_code, p.chapter, p.sequence_no, p.language_code, coalesce(l.quality, 0) AS priority FROM page p LEFT JOIN labels l ON l.doc_id = p.doc_id""",
        "browse_page_deep": f"""WITH {docs}, placed AS (SELECT *, row_number() OVER (ORDER BY book_code NULLS FIRST, chapter NULLS FIRST, sequence_no, id) - 1 AS place FROM docs)
            SELECT place, id, book_code, chapter, sequence_no FROM placed WHERE place >= 650 AND place < 950""",
        "pairs": f"""WITH items AS ({ITEMS}), s AS (SELECT * FROM items WHERE language_role = 'source'), t AS (SELECT * FROM items WHERE language_role = 'target')
            SELECT coalesce(s.semantic_key, t.semantic_key) AS key, s.id AS source_id, t.id AS target_id, sha256(s.current_text) AS source_hash, sha256(t.current_text) AS target_hash,
                   CAST((s.id IS NOT NULL)::INT + (t.id IS NOT NULL)::INT AS BIGINT) AS n FROM s FULL JOIN t ON s.semantic_key = t.semantic_key""",
        "pairs_page": f"""WITH items AS ({ITEMS}), keys AS (
              SELECT semantic_key, min(chapter) AS first_chapter, min(sequence_no) AS first_seq FROM items WHERE book_code = 'PSA' AND content_type = 'study_note' GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 20)
            SELECT semantic_key AS key, max(CASE WHEN language_role = 'source' THEN id END) AS source_id, max(CASE WHEN language_role = 'target' THEN id END) AS target_id, first_chapter, first_seq
            FROM items JOIN keys USING (semantic_key) GROUP BY 1, 4, 5""",
        "one_sided": f"""WITH items AS ({ITEMS}) SELECT semantic_key AS key, CASE WHEN min(language_role) = 'source' THEN 'source_only' ELSE 'target_only' END AS side, min(id) AS id
            FROM items GROUP BY 1 HAVING count(DISTINCT language_role) = 1""",
        "qa_issues": f"WITH {issues} SELECT {issue_columns} FROM issues",
        "qa_summary": f"WITH {issues}, levels(severity, rank) AS (VALUES {_values((s, i) for i, s in enumerate(dims.SEVERITIES))}) SELECT severity, CAST(rank AS BIGINT) AS rank, count(fingerprint) AS n FROM levels LEFT JOIN issues USING (severity) GROUP BY 1, 2",
        "issue_list": f"""WITH {issues}, top AS (SELECT *, CAST({severity_rank} AS BIGINT) AS rank FROM issues ORDER BY rank, fingerprint LIMIT 200)
            SELECT fingerprint, rank, category, content_item_id, a.book_code, a.chapter, sha256(b.current_text) AS paired_hash FROM top LEFT JOIN items a ON a.id = content_item_id LEFT JOIN items b ON b.id = paired_content_item_id""",
        "vocabulary_topk": f"""WITH {docs}, w AS (SELECT unnest(regexp_extract_all(regexp_replace(nfc_normalize(current_text), '\\\\[A-Za-z0-9]+\\*?', ' ', 'g'), '[\\p{{L}}\\p{{M}}]+')) AS word FROM docs WHERE language_code = 'en')
            SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 80""",
        "import_classify": f"WITH {_classified(True)} SELECT id, logical_key, resource_role, status, cross_role, anchor_id, old_role, recommendation FROM classified",
        "import_summary": f"""WITH {_classified(False)} SELECT count(*) FILTER (status = 'new') AS new_items, count(*) FILTER (status = 'identical') AS exact_items, count(*) FILTER (status = 'conflict') AS changed_items,
            count(*) FILTER (cross_role) AS overlaps, count(*) FILTER (recommendation = 'use_incoming') AS recommended_incoming, count(*) FILTER (recommendation = 'keep_existing') AS recommended_existing,
            count(*) FILTER (recommendation = 'manual_review') AS manual_review FROM classified""",
        "conflict_list": f"""WITH {_classified(True)} SELECT sha256(concat(c.id, '|', anchor_id)) AS conflict_id, c.id AS incoming_id, anchor_id, c.resource_role AS incoming_role, old_role AS existing_role, recommendation,
            CASE recommendation WHEN 'use_incoming' THEN 1 WHEN 'manual_review' THEN 2 ELSE 3 END AS rank, sha256(s.current_text) AS existing_hash FROM classified c JOIN stored s ON s.id = anchor_id WHERE status = 'conflict'""",
        "resolve_next_state": f"""WITH {_classified(True)}, {_DECIDED}
            SELECT s.id, CASE WHEN l.anchor_id IS NULL THEN s.review_status ELSE 'needs_review' END AS review_status, sha256(coalesce(l.new_text, s.current_text)) AS text_hash FROM stored s LEFT JOIN last l ON l.anchor_id = s.id""",
        "usfm_items": """WITH o AS (SELECT o_orderpriority AS file, o_orderkey AS k, o_custkey, o_orderstatus AS status FROM orders),
            lines AS (
              SELECT file, k, 0 AS j, 'book_id' AS content_type, ['GEN', 'EXO', 'LEV'][CAST(floor(k / 2000) % 3 + 1 AS INTEGER)] AS code, CAST(NULL AS INTEGER) AS number, CAST(NULL AS VARCHAR) AS verse, 'Orders' AS current_text FROM o WHERE k % 2000 = 0
              UNION ALL SELECT file, k, 1, 'chapter', NULL, CAST(o_custkey % 40 + 1 AS INTEGER), NULL, CAST(o_custkey % 40 + 1 AS VARCHAR) FROM o WHERE k % 10 = 0
              UNION ALL SELECT file, k, 2, 'scripture', NULL, NULL, CAST(k % 5 AS VARCHAR), concat(status, ' of ', o_custkey) FROM o
              UNION ALL SELECT file, k, 3, 'section_heading', NULL, NULL, CAST(k % 5 AS VARCHAR), status FROM o),
            told AS (
              SELECT *, row_number() OVER w AS line_no, last_value(code IGNORE NULLS) OVER w AS book, last_value(number IGNORE NULLS) OVER w AS chapter FROM lines
              WINDOW w AS (PARTITION BY file ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
            items AS (
              SELECT *, 0 AS pos FROM told UNION ALL
              SELECT * REPLACE ('footnote' AS content_type, concat('+ note ', k) AS current_text), 1 FROM told WHERE content_type = 'scripture' AND k % 3 = 0),
            scoped AS (SELECT *, concat_ws('|', coalesce(book, 'UNK'), coalesce(chapter, 0), coalesce(verse, ''), content_type) AS scope FROM items),
            nths AS (SELECT *, row_number() OVER (PARTITION BY file, scope ORDER BY k, j, pos) - 1 AS n, row_number() OVER (PARTITION BY file ORDER BY k, j, pos) - 1 AS seq FROM scoped),
            keyed AS (SELECT *, CASE content_type WHEN 'scripture' THEN scope WHEN 'chapter' THEN concat_ws('|', coalesce(book, 'UNK'), coalesce(chapter, 0), 'chapter') WHEN 'book_id' THEN concat(coalesce(book, 'UNK'), '|book_id') END AS own FROM nths)
            SELECT file, CAST(seq AS INTEGER) AS sequence_no, content_type, chapter, verse, coalesce(own, concat_ws('|', scope, CASE content_type WHEN 'footnote' THEN 'f' ELSE 's1' END, '', n)) AS semantic_key, coalesce(own, concat_ws('|', scope, n)) AS match_key,
              current_text, sha256(current_text) AS content_hash, concat('line:', line_no, CASE WHEN pos = 1 THEN ':footnote' ELSE '' END) AS source_locator FROM keyed""",
        "html_extract": f"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, array_to_string(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), '|') AS hs FROM pages)
            SELECT page_id, {_unescape('t')} AS title, {_unescape('hs')} AS headings FROM h""",
        "canonical_export": f"WITH items AS ({ITEMS}) SELECT " + ", ".join(f"coalesce({_CANON[h]}, '') AS \"{h}\"" if h in _CANON else f"'' AS \"{h}\"" for h in dims.HEADERS) + " FROM items",
        "csv_export": f"WITH {docs} SELECT concat_ws(',', " + ", ".join(_cell(csv[h]) if h in csv else "''" for h in dims.HEADERS) + ") AS line FROM docs",
        "bilingual_export": f"""WITH items AS ({ITEMS}),
            g AS (SELECT semantic_key AS key, min(sequence_no) AS seq, max(CASE WHEN language_role = 'source' THEN id END) AS sid, max(CASE WHEN language_role = 'target' THEN id END) AS tid FROM items GROUP BY 1)
            SELECT CAST(row_number() OVER (ORDER BY seq, key) AS INTEGER) AS no, key, concat('\\', coalesce(s.marker, t.marker)) AS tags, CAST(coalesce(s.chapter, t.chapter) AS VARCHAR) AS chapter, coalesce(s.verse, t.verse) AS verse, '' AS sub_tags,
              coalesce(s.content_type, t.content_type) AS content_type, coalesce(s.protection_level, t.protection_level) AS protection, coalesce(s.current_text, '') AS english, coalesce(t.current_text, '') AS translation
            FROM g LEFT JOIN items s ON s.id = sid LEFT JOIN items t ON t.id = tid""",
        "qa_details": f"WITH {issues} SELECT fingerprint, message, evidence, CAST(NULL AS VARCHAR) AS suggested_text FROM issues",
        "qa_result": f"""WITH {issues}, levels(severity) AS (VALUES {_values((s,) for s in dims.SEVERITIES)}), open_ AS (SELECT * FROM issues WHERE severity <> 'info')
            SELECT 'total' AS section, 'created' AS name, count(*) AS n FROM issues UNION ALL SELECT 'total', 'open', count(*) FROM open_
            UNION ALL SELECT 'severity', severity, count(fingerprint) FROM levels LEFT JOIN open_ USING (severity) GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM open_ GROUP BY category""",
        "issue_page": f"""WITH {issues}, top AS (SELECT *, CAST({severity_rank} AS BIGINT) AS rank, {age} AS created_at FROM issues WHERE severity = 'high' ORDER BY rank, created_at DESC, fingerprint LIMIT 100)
            SELECT fingerprint, rank, category, top.created_at, a.book_code, a.verse FROM top LEFT JOIN items a ON a.id = content_item_id""",
        "conflict_reasons": f"WITH {_classified(True)} SELECT id, recommendation, reason, protected FROM classified WHERE status = 'conflict'",
        "preview_languages": f"""WITH {_classified(False)}, known(language_role) AS (VALUES ('source'), ('target'), ('auxiliary'), ('unassigned'))
            SELECT k.language_role, count(i.id) AS n FROM known k LEFT JOIN incoming i ON coalesce(i.language_role, 'unassigned') = k.language_role GROUP BY 1""",
        "preview_examples": f"""WITH {_classified(False)} SELECT id, match_key, content_type, old_role AS existing_role, resource_role AS incoming_role, recommendation, reason, protected AS protected_scripture
            FROM classified WHERE status = 'conflict' ORDER BY sequence_no, id LIMIT 8""",
        "commit_books": f"WITH {_classified(True)} SELECT DISTINCT book_code FROM incoming WHERE book_code <> 'GEN'",
        "commit_resources": f"""WITH {_classified(True)}, {_FILES} SELECT f.file_id, f.resource_role, CASE WHEN NOT coalesce(bool_or(i.language_role = 'source') AND bool_or(i.language_role = 'target'), false) THEN f.language_code END AS language_code,
            CASE WHEN count(DISTINCT i.book_code) = 1 THEN min(i.book_code) END AS book_code, f.filename AS title FROM files f LEFT JOIN incoming i ON i.file_id = f.file_id GROUP BY f.file_id, f.resource_role, f.language_code, f.filename""",
        "commit_batches": f"""WITH {_classified(True)}, {_FILES} SELECT f.batch_id, count(*) FILTER (c.status = 'new') AS inserted, count(*) FILTER (c.status = 'identical') AS skipped, count(*) FILTER (c.status = 'conflict') AS changed,
            count(*) FILTER (c.cross_role) AS overlaps, 'committed' AS status FROM files f LEFT JOIN classified c ON c.file_id = f.file_id GROUP BY 1""",
        "conflict_center": f"""WITH {_classified(True)}, {_FILES} SELECT sha256(concat(c.id, '|', anchor_id)) AS conflict_id, CASE recommendation WHEN 'use_incoming' THEN 1 WHEN 'manual_review' THEN 2 ELSE 3 END AS rank, c.created_at,
            n.n_name AS existing_resource, f.filename AS incoming_filename, s.marker AS existing_marker, s.review_status, s.book_code, s.chapter, sha256(s.raw_text) AS existing_raw_hash, reason
            FROM classified c JOIN stored s ON s.id = anchor_id LEFT JOIN nation n ON concat('n', n.n_nationkey) = s.resource_id LEFT JOIN files f ON f.file_id = c.file_id WHERE c.status = 'conflict'""",
        "conflict_rollup": f"WITH {_classified(True)} SELECT resource_role AS incoming_role, recommendation, count(*) AS n FROM classified WHERE status = 'conflict' GROUP BY 1, 2",
        "resolve_places": f"""WITH {_classified(True)}, {_DECIDED} SELECT s.id, coalesce(l.resource_id, s.resource_id) AS resource_id, coalesce(l.source_locator, s.source_locator) AS source_locator FROM stored s LEFT JOIN last l ON l.anchor_id = s.id""",
        "resolve_conflicts": f"""WITH {_classified(True)} SELECT sha256(concat(c.id, '|', anchor_id)) AS conflict_id, CASE WHEN taken THEN action ELSE 'pending' END AS status, CASE WHEN taken AND content_type <> 'figure' THEN 'checked' END AS resolution_reason,
            CASE WHEN taken THEN concat('editor ', c.id) END AS resolved_by, CASE WHEN taken THEN created_at END AS resolved_at
            FROM (SELECT c.*, CASE WHEN recommendation = 'manual_review' THEN 'manual_merge' ELSE recommendation END AS action, s.id IS NOT NULL AND
                    (recommendation = 'keep_existing' OR (c.content_type <> 'figure' AND (s.protection_level <> 'protected_scripture' OR length(c.current_text) % 2 = 0))) AS taken
                  FROM classified c LEFT JOIN stored s ON s.id = anchor_id WHERE c.status = 'conflict') AS c""",
        "authority_rules": f"""WITH items AS ({ITEMS}) SELECT r.content_type, r.resource_role, r.priority, count(i.id) AS n_items FROM (VALUES {_values(dims.AUTHORITY)}) AS r(content_type, resource_role, priority)
            LEFT JOIN items i ON i.content_type = r.content_type AND i.resource_role = r.resource_role GROUP BY 1, 2, 3""",
        "role_guess": f"""SELECT s_suppkey, CASE WHEN regexp_matches(n, 'cross|reference') THEN 'cross_references' WHEN regexp_matches(n, 'foot') THEN 'footnotes' WHEN regexp_matches(n, 'intro|back matter|glossary') THEN 'introductions'
            WHEN regexp_matches(n, 'map|chart') THEN 'maps_charts' WHEN regexp_matches(n, 'study|sub-?heading') THEN 'study_notes' WHEN contains(n, 'gsb') AND regexp_matches(n, '[.](sfm|usfm)$') THEN 'source_scripture'
            WHEN regexp_matches(n, 'irv|tam') AND regexp_matches(n, '[.](sfm|usfm)$') THEN 'target_scripture' ELSE 'other' END AS role FROM (SELECT s_suppkey, lower(filename) AS n FROM ({FILE_NAMES}) AS f) AS g""",
        "resolve_versions": f"""WITH {_classified(True)}, {_DECIDED}, kinds AS (SELECT sha256(concat(id, '|', anchor_id)) AS conflict_id, CASE recommendation WHEN 'manual_review' THEN 'manual_merge' ELSE recommendation END AS change_type FROM classified WHERE status = 'conflict')
            SELECT d.anchor_id AS content_item_id, CAST(CASE WHEN s.sequence_no % 3 = 0 THEN 4 ELSE 0 END + row_number() OVER w AS INTEGER) AS revision_no, sha256(coalesce(lag(new_text) OVER w, s.current_text)) AS text_hash, change_type, 'checked' AS reason
            FROM decided d JOIN stored s ON s.id = d.anchor_id JOIN kinds USING (conflict_id) WINDOW w AS (PARTITION BY d.anchor_id ORDER BY conflict_id)
            UNION ALL SELECT id, 4, sha256('before'), 'manual_merge', 'earlier' FROM stored WHERE sequence_no % 3 = 0""",
        "resolve_refused": f"""WITH {_classified(True)} SELECT sha256(concat(c.id, '|', anchor_id)) AS conflict_id, CASE recommendation WHEN 'manual_review' THEN 'manual_merge' ELSE recommendation END AS action,
            CASE WHEN s.id IS NULL THEN 'conflict not found' WHEN s.protection_level = 'protected_scripture' AND length(c.current_text) % 2 = 1 THEN 'protected text needs confirmation' ELSE 'a reason is required' END AS error
            FROM classified c LEFT JOIN stored s ON s.id = anchor_id
            WHERE status = 'conflict' AND (s.id IS NULL OR (recommendation <> 'keep_existing' AND (c.content_type = 'figure' OR (s.protection_level = 'protected_scripture' AND length(c.current_text) % 2 = 1))))""",
        "parser_statistics": """WITH o AS (SELECT o_orderpriority AS file, o_orderkey AS k, o_custkey FROM orders), told AS (
              SELECT *, last_value(CASE WHEN k % 10 = 0 THEN o_custkey % 40 + 1 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM o),
            counts AS (SELECT file, 'book_id' AS t, count(*) FILTER (k % 2000 = 0) AS n FROM o GROUP BY 1 UNION ALL SELECT file, 'chapter', count(*) FILTER (k % 10 = 0) FROM o GROUP BY 1
              UNION ALL SELECT file, 'footnote', count(*) FILTER (k % 3 = 0) FROM o GROUP BY 1 UNION ALL SELECT file, 'scripture', count(*) FROM o GROUP BY 1 UNION ALL SELECT file, 'section_heading', count(*) FROM o GROUP BY 1)
            SELECT file, (SELECT array_to_string(list_sort(list(DISTINCT chapter)), ',') FROM told t WHERE t.file = c.file AND chapter IS NOT NULL) AS chapters, max(n) FILTER (t = 'scripture') AS verses,
              string_agg(concat(t, '=', n), ';' ORDER BY t) FILTER (n > 0) AS stats FROM counts c GROUP BY file""",
        "file_formats": f"""SELECT s_suppkey, CASE WHEN e IN ('usfm', 'sfm', 'csv', 'tsv', 'json', 'docx', 'doc') THEN e END AS format FROM (SELECT s_suppkey, lower(regexp_extract(filename, '[.]([^./]+)$', 1)) AS e FROM ({FILE_NAMES}) AS f) AS g""",
        "mixed_files": """WITH s AS (SELECT s_name, s_suppkey % 6 AS n FROM supplier), found(n, ending, content_type, semantic_key, named, fixed, warning) AS (VALUES
              (0, 'sfm', 'book_id', 'GEN|book_id', false, '', NULL), (0, 'sfm', 'chapter', 'GEN|1|chapter', false, '1', NULL), (0, 'sfm', 'scripture', 'GEN|1|1|scripture', true, NULL, NULL), (1, 'CSV', 'table_row', 'ROW|1', true, NULL, NULL),
              (2, 'tsv', 'table_row', 'ROW|1', true, NULL, NULL), (3, 'Json', 'json_record', 'JSON|1', true, NULL, NULL), (4, 'csv', 'unreadable', NULL, false, NULL, 'a quoted field is not closed'), (5, 'pdf', 'unreadable', NULL, false, NULL, 'unsupported format'))
            SELECT concat(s_name, '.', ending) AS file, content_type, semantic_key, CASE WHEN named THEN s_name ELSE fixed END AS current_text, warning FROM s JOIN found USING (n)""",
        "canonical_csv_items": f"""SELECT p_brand AS file, 'MAT' AS book_code, p_size AS chapter, '4' AS verse, CASE WHEN p_partkey % 2 = 0 THEN 'footnote' ELSE 'table_row' END AS content_type, CAST(NULL AS VARCHAR) AS marker, {nth} AS sequence_no,
            concat('P|', p_partkey) AS semantic_key, concat('P|', p_partkey) AS match_key, p_name AS current_text, 'source' AS language_role, concat('row:', {nth} + 2) AS source_locator, 'footnotes' AS resource_role, 'normal' AS protection_level, p_name AS raw_text FROM part""",
        "docx_types": """SELECT concat('PSA ', CAST(floor(s_suppkey / 30) AS BIGINT), '.docx') AS file, concat('S|', s_suppkey) AS semantic_key, 'PSA' AS book_code, concat('\\', ['f', 'x', 's1', 'c', 'v', 'fig', 'ef', 'p'][s_suppkey % 8 + 1]) AS marker, r.role AS language_role, CASE r.role WHEN 'source' THEN s_name ELSE '' END AS current_text,
            ['footnote', 'cross_reference', 'section_heading', 'chapter_marker', 'scripture_fragment', 'figure', 'study_note', 'docx_record'][s_suppkey % 8 + 1] AS content_type FROM supplier, (VALUES ('source'), ('target')) AS r(role)""",
        "json_export": """WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS no, * FROM customer) SELECT no, concat(CASE WHEN no > 1 THEN ',' ELSE '' END, CAST(json_object(""" + ", ".join(f"'{h}', " + {"semanticKey": "concat('C|', c_custkey)", "matchKey": "concat('C|', c_custkey)", "sequenceNo": "CAST(c_custkey AS INTEGER)", "currentText": "c_name", "rawText": "concat('\"', c_mktsegment, '\" \\ /')", "languageCode": "'en'", "protectionLevel": "'normal'", "reviewStatus": "'unreviewed'"}.get(h, "''") for h in dims.HEADERS) + f""") AS VARCHAR)) AS text FROM c
            UNION ALL VALUES (0, '{{"schemaVersion":"{dims.EXCHANGE_VERSION}","exportedAt":"2024-01-01T00:00:00.000Z","items":['), (4611686018427387904, ']}}')""",
        "marker_export": f"""WITH items AS ({ITEMS}), x AS (SELECT *, CASE WHEN sequence_no % 3 = 0 THEN concat(' \\p ', raw_text) ELSE '' END AS raw, CASE WHEN sequence_no % 5 > 0 THEN marker ELSE '' END AS mark FROM items WHERE sequence_no % 7 > 0),
            l AS (SELECT book_code, sequence_no, CASE WHEN raw <> '' THEN raw WHEN mark <> '' THEN concat('\\', mark, CASE WHEN current_text <> '' THEN concat(' ', current_text) ELSE '' END) WHEN current_text <> '' THEN current_text END AS line FROM x)
            SELECT book_code, sequence_no, sha256(line) AS line_hash FROM l WHERE line IS NOT NULL""",
        "absent_keys": "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)",
        "issues_next": f"""WITH {issues}, earlier AS (
              SELECT fingerprint, category, CASE WHEN fingerprint LIKE '1%' THEN 'rejected' WHEN severity = 'info' THEN 'accepted' ELSE 'open' END AS status, CASE WHEN fingerprint LIKE '0%' THEN 'person' ELSE '{dims.ENGINE}' END AS engine FROM issues WHERE fingerprint NOT LIKE 'f%'),
            stay AS (SELECT * FROM earlier WHERE NOT (status = 'open' AND engine = '{dims.ENGINE}'))
            SELECT fingerprint, status, engine, category FROM stay UNION ALL SELECT fingerprint, 'open', '{dims.ENGINE}', category FROM issues WHERE fingerprint NOT IN (SELECT fingerprint FROM stay)""",
        "issue_status": f"WITH {issues} SELECT fingerprint, CASE WHEN fingerprint = (SELECT min(fingerprint) FROM issues) THEN 'deferred' WHEN severity = 'info' THEN 'accepted' ELSE 'open' END AS status FROM issues",
        "rules_listed": """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'proposed' END AS status, p_size AS evidence_count FROM part ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, p_size DESC, p_partkey LIMIT 500""",
        "clean_cells": f"""WITH {docs}, c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' n/A ' ELSE concat('  ', chr(13), current_text, '  ', chr(10), '  end ', chr(65279)) END AS cell FROM docs),
            s AS (SELECT doc_id, {_trim("regexp_replace(regexp_replace(regexp_replace(nfc_normalize(cell), '" + _ZW + "', '', 'g'), '[ \r]+', ' ', 'g'), ' *\n *', chr(10), 'g')")} AS s FROM c)
            SELECT doc_id, sha256(CASE WHEN lower(s) IN ('na', 'n/a') THEN '' ELSE s END) AS cell_hash FROM s""",
        "resolved_languages": """WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'target' END AS own, CASE doc_id % 3 WHEN 0 THEN lang END AS given, doc_id % 5 AS r FROM documents),
            t AS (SELECT *, coalesce(own, CASE WHEN r = 0 THEN 'source' WHEN r = 1 THEN 'target' WHEN given = 'en' THEN 'source' WHEN given = 'fr' THEN 'target' END) AS role FROM i)
            SELECT doc_id, role AS language_role, coalesce(CASE own WHEN 'source' THEN 'en' WHEN 'target' THEN 'fr' ELSE given END, CASE role WHEN 'source' THEN 'en' WHEN 'target' THEN 'fr' END) AS language_code FROM t""",
        "fresh_ids": "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) AS n_good FROM documents",
        "project_lookup": """SELECT n_nationkey AS project_id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = 7) AS book_count, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS item_count FROM nation WHERE n_nationkey = 7""",
        "project_stats": f"""WITH {docs}, {issues}, {_classified(True)}, b AS (SELECT concat('B', CAST(i AS VARCHAR)) AS book_code FROM range(12) t(i))
            SELECT 'totals' AS section, 'items' AS name, count(*) AS n FROM docs UNION ALL SELECT 'totals', 'protected', count(*) FROM docs WHERE protection_level = 'protected_scripture'
            UNION ALL SELECT 'totals', 'approved', count(*) FROM docs WHERE review_status = 'approved' UNION ALL SELECT 'type', content_type, count(*) FROM docs GROUP BY 2
            UNION ALL SELECT 'book items', b.book_code, count(d.id) FROM b LEFT JOIN docs d USING (book_code) GROUP BY 2 UNION ALL SELECT 'book chapters', b.book_code, count(DISTINCT d.chapter) FROM b LEFT JOIN docs d USING (book_code) GROUP BY 2
            UNION ALL SELECT 'file', filename, s_suppkey FROM ({FILE_NAMES}) AS f UNION ALL SELECT 'open issues', severity, count(*) FROM issues WHERE severity <> 'info' GROUP BY 2
            UNION ALL SELECT 'conflicts', 'pending', count(*) FROM classified WHERE status = 'conflict'""",
        "export_rows": f"""WITH items AS ({ITEMS}) SELECT id, book_code, chapter, sequence_no, n_name AS resource_title FROM items JOIN nation ON n_nationkey = sequence_no % 25
            WHERE language_code = 'ta' AND n_nationkey % 2 = 0 AND sequence_no % 10 <> 9""",
        **{
            f"{kind}_items": f"""SELECT p_brand AS file, 'MAT' AS book_code, p_size AS chapter, '1-2' AS verse, 'table_row' AS content_type, '\\s' AS marker, {nth} AS sequence_no, concat('P|', p_partkey) AS semantic_key, concat('P|', p_partkey) AS match_key,
            concat('say "', p_name, '"', {delimiter}, chr(10), p_size) AS current_text, CAST(NULL AS VARCHAR) AS language_role, concat('row:', {nth} + 2) AS source_locator FROM part"""
            for kind, delimiter in (("csv", "','"), ("tsv", "chr(9)"))
        },
        "json_items": f"""SELECT p_brand AS file, 'MRK' AS book_code, nullif(p_size, 0) AS chapter, CAST(NULL AS VARCHAR) AS verse, 'json_record' AS content_type, CAST(NULL AS VARCHAR) AS marker, CAST({nth} + 1 AS INTEGER) AS sequence_no, concat('P|', p_partkey) AS semantic_key,
            concat('P|', p_partkey) AS match_key, concat(p_name, ' }}') AS current_text, 'source' AS language_role, concat('record:', {nth} + 2) AS source_locator FROM part
            UNION ALL SELECT DISTINCT p_brand, NULL, NULL, NULL, 'json_record', NULL, 0, 'JSON|1', 'JSON|1', 'first', NULL, 'record:1' FROM part""",
        "docx_items": """WITH c AS (SELECT c_custkey, c_name, c_nationkey % 5 + 1 AS chapter, CAST(floor(c_custkey / 60) AS BIGINT) AS part FROM customer)
            SELECT concat('book/MAT-notes-', part, '.docx') AS file, 'MAT' AS book_code, CAST(chapter AS INTEGER) AS chapter, '3' AS verse, 'footnote' AS content_type, '\\f' AS marker, CAST((c_custkey % 60) * 2 + k AS INTEGER) AS sequence_no,
            concat('N|', c_custkey) AS semantic_key, concat('MAT|', chapter, '|3|footnote|', row_number() OVER (PARTITION BY part, chapter, k ORDER BY c_custkey) - 1) AS match_key,
            concat(c_name, ' & <', role, '> "x"', chr(10), '2') AS current_text, role AS language_role, concat('table-row:', c_custkey % 60 + 2) AS source_locator FROM c, (VALUES (0, 'source'), (1, 'target')) AS r(k, role)""",
        "duplicate_members": f"""WITH items AS ({ITEMS}) SELECT concat_ws('|', resource_role, language_code, match_key) AS key, first_value(id) OVER (PARTITION BY resource_role, language_code, match_key ORDER BY book_code, chapter, sequence_no, id) AS first, id, resource_role
            FROM items QUALIFY count(*) OVER (PARTITION BY resource_role, language_code, match_key) > 1""",
        "noted_usfm_items": """WITH parts(sequence_no, chapter, verse, content_type, marker, tail, match_tail, source_locator, parent, warning) AS (VALUES
              (0, NULL, NULL, 'book_id', 'id', 'book_id', 'book_id', 'line:1', NULL, NULL), (1, 1, NULL, 'chapter', 'c', '1|chapter', '1|chapter', 'line:2', NULL, NULL),
              (2, 1, '1', 'scripture', 'v', '1|1|scripture', '1|1|scripture', 'line:3', NULL, NULL), (3, 1, '1', 'footnote', 'f', '1|1|footnote|f||0', '1|1|footnote|0', 'line:3:footnote', 'JON|1|1|scripture', NULL),
              (4, 1, '2-3', 'scripture', 'v', '1|2-3|scripture', '1|2-3|scripture', 'line:4', NULL, NULL),
              (5, 1, '2-3', 'cross_reference', 'x', '1|2-3|cross_reference|x||0', '1|2-3|cross_reference|0', 'line:4:crossref', 'JON|1|2-3|scripture', 'unclosed_cross_reference'),
              (6, 1, '2-3', 'continuation', NULL, '1|2-3|continuation|||0', '1|2-3|continuation|0', 'line:5', NULL, NULL), (7, 1, '2-3', 'section_heading', 's1', '1|2-3|section_heading|s1||0', '1|2-3|section_heading|0', 'line:6', NULL, NULL)),
            texts AS (SELECT p.*, n_nationkey, regexp_extract(n_name, '[0-9]+') AS d, CASE sequence_no WHEN 0 THEN n_name WHEN 1 THEN '1' WHEN 2 THEN 'Before after word' WHEN 3 THEN concat('+ note ', n_name) WHEN 4 THEN 'Open' WHEN 5 THEN '+ Gen 1:1'
              WHEN 6 THEN concat('plain ', n_name) ELSE concat('Head ', chr(3047)) END AS current_text FROM nation, parts p)
            SELECT concat('n', n_nationkey) AS file, 'JON' AS book_code, CAST(chapter AS INTEGER) AS chapter, verse, content_type, marker, CAST(sequence_no AS INTEGER) AS sequence_no, concat('JON|', tail) AS semantic_key, concat('JON|', match_tail) AS match_key,
              current_text, source_locator, parent AS parent_semantic_key, warning, CASE WHEN sequence_no IN (0, 3, 6) THEN d WHEN sequence_no IN (1, 7) THEN '1' WHEN sequence_no = 5 THEN '1:1' ELSE '' END AS numbers FROM texts""",
        "publication_gate": f"""WITH {issues}, {_classified(True)}, a AS (SELECT count(*) AS items FROM items), b AS (SELECT count(*) AS pending_conflicts FROM classified WHERE status = 'conflict'),
            c AS (SELECT count(*) FILTER (severity <> 'info') AS open_issues, count(*) FILTER (severity = 'critical') AS critical_issues, count(*) FILTER (severity = 'high') AS high_issues FROM issues)
            SELECT *, items > 0 AND pending_conflicts = 0 AND open_issues = 0 AS ready FROM a, b, c""",
    }


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _categories() -> dict[str, tuple[str, ...]]:
    return {
        "unicode_checks": ("unicode_zero_width", "unicode_replacement_character", "invalid_control_character", "unicode_normalization"),
        "marker_spacing": ("usfm_marker_spacing",),
        "marker_balance": ("usfm_marker_balance",),
        "anchor_range": ("invalid_chapter_anchor",),
        "number_mismatch": ("number_mismatch",),
        "empty_target": ("empty_target_content",),
        "marker_sequence": ("usfm_marker_sequence_mismatch",),
        "versification": ("versification_difference",),
        "duplicate_record": ("duplicate_canonical_record",),
    }
