"""The twelve deterministic data-quality rules over canonical items.

All rules on single records are evaluated in one pass as an array of findings that is exploded once;
the rules on pairs share one pivot; only duplicate identity needs a grouping of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import dims
from vellum.functions import text as T
from vellum.operators import pairing, scans

INVISIBLE = r"[\u200B\u200C\u200D\u2060\uFEFF]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SPACED_MARKER = rf"\\{T.WHITE}+[A-Za-z][A-Za-z0-9]*|\\[A-Za-z][A-Za-z0-9]*{T.WHITE}+\*"
COLUMNS = ["content_item_id", "paired_content_item_id", "category", "severity", "confidence", "fingerprint", "message", "evidence", "suggested_text"]

# What each rule says.
MESSAGES = {
    "unicode_zero_width": "Invisible zero-width Unicode character detected.",
    "unicode_replacement_character": "Unicode replacement character (U+FFFD) detected; source text may have been decoded incorrectly.",
    "invalid_control_character": "Unexpected control character detected in publishable text.",
    "unicode_normalization": "Text is not in canonical NFC Unicode normalization.",
    "usfm_marker_spacing": "Malformed USFM marker spacing detected.",
    "usfm_marker_balance": "Unbalanced \\{0} … \\{0}* marker pair detected.",
    "invalid_chapter_anchor": "Chapter {0} is outside the supported range for {1} (1–{2}).",
    "number_mismatch": "Source and target numeric sequences differ. Review whether the difference is intentional.",
    "empty_target_content": "Source content is present but the paired target field is empty.",
    "usfm_marker_sequence_mismatch": "Source and target inline USFM marker sequences differ.",
    "source_only": "Scripture verse exists in the source edition but no paired target verse was found.",
    "target_only": "Scripture verse exists in the target edition but no paired source verse was found. Treat as a possible versification/textual-edition difference, not an automatic translation error.",
    "duplicate_canonical_record": "Multiple active database records share the same language and canonical match identity.",
}


def _finding(when: Column, category: str, severity: str, confidence: float, parts: list[Column], message: Column | None = None, **evidence: Column) -> Column:
    """A finding where `when` holds; evidence: columns by the names they have in its JSON."""
    said = F.lit(MESSAGES[category]) if message is None else message
    shown = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()]), {"ignoreNullFields": "false"})
    return F.when(
        when,
        F.struct(
            F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), T.fingerprint(F.lit(dims.ENGINE), *parts).alias("fingerprint"),
            said.alias("message"), shown.alias("evidence"), F.lit(None).cast("string").alias("suggested_text"),
        ),
    )


def _told(template: str, *values: Column) -> Column:
    """A message with {0}, {1}, .. replaced."""
    said = F.lit(template)
    for k, v in enumerate(values):
        said = F.replace(said, F.lit(f"{{{k}}}"), v.cast("string"))
    return said


def record_findings(items: DataFrame) -> DataFrame:
    """Rules on one record: characters, normalisation, markers, chapter anchor."""
    known = dims.chapters(items.sparkSession)
    rows = items.join(F.broadcast(known), "book_code", "left")  # 66 rows
    text, raw, item = F.coalesce("current_text", F.lit("")), F.coalesce("raw_text", "current_text", F.lit("")), F.col("id")
    rows = rows.withColumn("_nfc", T.nfc(text)).withColumn("_text", text).withColumn("_raw", raw)
    text, raw, at = F.col("_text"), F.col("_raw"), F.col("source_locator")
    counts = {m: (T.marker_starts(raw, m), T.marker_ends(raw, m)) for m in "fx"}
    found = [
        _finding(text.rlike(INVISIBLE), "unicode_zero_width", "medium", 1.0, [F.lit("zero_width"), item], sourceLocator=at, characters=T.code_points(text, INVISIBLE)),
        _finding(text.contains("\ufffd"), "unicode_replacement_character", "high", 1.0, [F.lit("replacement"), item], sourceLocator=at),
        _finding(text.rlike(CONTROL), "invalid_control_character", "high", 1.0, [F.lit("control"), item], sourceLocator=at),
        _finding(text != F.col("_nfc"), "unicode_normalization", "low", 1.0, [F.lit("nfc"), item], sourceLocator=at),
        _finding(raw.rlike(SPACED_MARKER), "usfm_marker_spacing", "high", 0.99, [F.lit("marker_spacing"), item], sourceLocator=at, rawText=raw),
        *[
            _finding(a != b, "usfm_marker_balance", "high", 1.0, [F.lit("marker_balance"), F.lit(m), item, a, b], _told(MESSAGES["usfm_marker_balance"], F.lit(m)), sourceLocator=at, startCount=a, endCount=b, rawText=raw)
            for m, (a, b) in counts.items()
        ],
        _finding(
            (F.col("chapter") < 1) | (F.col("chapter") > F.col("max_chapter")), "invalid_chapter_anchor", "critical", 1.0, [F.lit("chapter_range"), item],
            _told(MESSAGES["invalid_chapter_anchor"], F.col("chapter"), F.col("book_code"), F.col("max_chapter")), bookCode=F.col("book_code"), chapter=F.col("chapter"), maxChapter=F.col("max_chapter"),
        ),
    ]
    # the anchor rule needs a known book
    found[-1] = F.when(F.col("max_chapter").isNotNull(), found[-1])
    each = rows.select(item.alias("content_item_id"), F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
    return each.select("content_item_id", F.lit(None).cast("string").alias("paired_content_item_id"), "f.*").select(*COLUMNS)


def pair_findings(items: DataFrame) -> DataFrame:
    """Rules on a source record and its target: numbers, empty target, markers, one-sided verses."""
    pairs = pairing.pivot(items, ["id", "content_type", "current_text", "raw_text", "resource_role", "book_code", "chapter", "verse", "protection_level", "source_locator"])
    s, t, key = F.col("source"), F.col("target"), F.col("key")
    pairs = pairs.select(
        "key", "source", "target",
        T.numbers(s["current_text"]).alias("sn"), T.numbers(t["current_text"]).alias("tn"),
        T.marker_sequence(s["raw_text"]).alias("sm"), T.marker_sequence(t["raw_text"]).alias("tm"),
    )
    join = lambda c: F.concat_ws(",", c)
    both = s.isNotNull() & t.isNotNull()
    sn, tn, sm, tm = map(F.col, ("sn", "tn", "sm", "tm"))
    plain = (s["content_type"] != "scripture") & (t["content_type"] != "scripture") & (s["resource_role"] == t["resource_role"]) & ~s["resource_role"].isin("source_scripture", "target_scripture")
    one = lambda c: F.coalesce(s[c], t[c])
    side = F.when(s.isNotNull(), "source_only").otherwise("target_only")
    found = [
        _finding(both & (F.array_sort(sn) != F.array_sort(tn)), "number_mismatch", "high", 0.98, [F.lit("numbers"), key, join(sn), join(tn)],
                 sourceNumbers=sn, targetNumbers=tn, sourceText=s["current_text"], targetText=t["current_text"], protectedScripture=t["protection_level"] == "protected_scripture"),
        _finding(both & s["content_type"].isin(*dims.TRANSLATED_TYPES) & ~T.is_blank(s["current_text"]) & T.is_blank(t["current_text"]), "empty_target_content", "high", 1.0, [F.lit("empty_target"), key],
                 sourceText=s["current_text"], sourceLocator=s["source_locator"], targetLocator=t["source_locator"]),
        _finding(both & plain & (sm != tm), "usfm_marker_sequence_mismatch", "medium", 0.98, [F.lit("marker_seq"), key, join(sm), join(tm)],
                 sourceMarkers=sm, targetMarkers=tm, sourceRaw=s["raw_text"], targetRaw=t["raw_text"]),
        _finding(~both & (one("content_type") == "scripture"), "versification_difference", "info", 1.0, [F.lit("versification"), key, side],
                 F.when(s.isNotNull(), MESSAGES["source_only"]).otherwise(MESSAGES["target_only"]), semanticKey=key, side=side, book=one("book_code"), chapter=one("chapter"), verse=one("verse")),
    ]
    each = pairs.select("source", "target", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
    paired = F.when(both, s["id"])
    return each.select(F.coalesce(t["id"], s["id"]).alias("content_item_id"), paired.alias("paired_content_item_id"), "f.*").select(*COLUMNS)


#: Records that the evidence of a repeated identity names; duplicate_members has them all.
EVIDENCE = 1000


def _identities(items: DataFrame) -> DataFrame:
    """id, resource_role, at, key of every item."""
    key = F.concat_ws("|", F.coalesce("resource_role", F.lit("")), F.coalesce("language_code", "language_role", F.lit("")), T.filled(F.col("match_key"), F.col("semantic_key"), F.col("logical_key")))
    return items.select("id", "resource_role", F.struct("book_code", "chapter", "sequence_no", "id").alias("at"), key.alias("key"))


def _repeated(keyed: DataFrame) -> DataFrame:
    """key, n, first (id) of the identities that more than one item has; counted before they are shuffled."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", "at").alias("first")).filter("n > 1")


def duplicate_members(items: DataFrame) -> DataFrame:
    """key, first, id, resource_role: one row for every record of a repeated identity."""
    keyed = _identities(items)
    return keyed.join(_repeated(keyed), "key").select("key", "first", "id", "resource_role")


def _streamed_fingerprints(keyed: DataFrame) -> DataFrame:
    """key, fingerprint (see T.fingerprint) of the sorted ids of a key, hashed as a sorted stream: no row holds the ids."""

    def run(stream: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(stream, lambda r: r["key"]):
            sha, between = hashlib.sha256("|".join((dims.ENGINE, "duplicate_match", key, "")).encode()), ""
            for x in own:
                sha.update((between + x["id"]).encode())
                between = ","
            yield {"key": key, "fingerprint": sha.hexdigest()}

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scans.mapped(keyed.select("key", "id").repartition(n, "key").sortWithinPartitions("key", "id"), run, "key string, fingerprint string")


def duplicate_findings(items: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """More than one record of a resource role, language and match identity.

    The evidence names the first `evidence` records in book order; an identity with more says how many
    there are (`records`), and duplicate_members lists them.
    """
    keyed = _identities(items)
    repeated = _repeated(keyed)
    held = keyed.join(repeated, "key")
    first = Window.partitionBy("key").orderBy("at")
    # the limit is applied before the shuffle too, so a key of any size brings `evidence` rows from each task
    shown = held.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= evidence)
    same = shown.groupBy("key", "first", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(F.struct("at", "resource_role"))).alias("ordered"))
    in_order = F.transform("ordered", lambda x: x["at"]["id"])
    roles = F.transform("ordered", lambda x: x["resource_role"])
    all_shown = F.col("n") <= evidence
    found = lambda **more: _finding(F.lit(True), "duplicate_canonical_record", "high", 1.0, [F.lit("duplicate_match"), F.col("key"), F.concat_ws(",", "ids")], matchIdentity=F.col("key"), recordIds=in_order, resourceRoles=roles, **more)
    f = F.when(all_shown, found()).otherwise(found(records=F.col("n")))
    large = _streamed_fingerprints(held.filter(F.col("n") > evidence)).withColumnRenamed("fingerprint", "_streamed")
    out = same.select("key", F.col("first").alias("content_item_id"), F.lit(None).cast("string").alias("paired_content_item_id"), all_shown.alias("_all"), f.alias("f")).join(large, "key", "left")
    out = out.select("content_item_id", "paired_content_item_id", "f.*", "_all", "_streamed")
    return out.withColumn("fingerprint", F.when(F.col("_all"), F.col("fingerprint")).otherwise(F.col("_streamed"))).select(*COLUMNS)


def findings(items: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """All findings, one for each fingerprint; those whose fingerprint a person has closed stay away."""
    out = record_findings(items).unionByName(pair_findings(items)).unionByName(duplicate_findings(items)).dropDuplicates(["fingerprint"])
    return out if closed is None else out.join(closed.select("fingerprint"), "fingerprint", "left_anti").select(*COLUMNS)


def next_issues(issues: DataFrame, items: DataFrame) -> DataFrame:
    """The next state of an issue table: open findings of this engine are replaced, all others stay."""
    stay = issues.filter(~((F.col("engine") == dims.ENGINE) & (F.col("status") == "open")))
    new = findings(items, stay.filter("fingerprint IS NOT NULL")).withColumns({"engine": F.lit(dims.ENGINE), "status": F.lit("open")})
    return stay.unionByName(new, allowMissingColumns=True)


def set_status(issues: DataFrame, fingerprint: str, status: str) -> DataFrame:
    if status not in ("open", "accepted", "rejected", "resolved", "deferred"):
        raise ValueError(f"no such status: {status}")
    return issues.withColumn("status", F.when(F.col("fingerprint") == fingerprint, status).otherwise(F.col("status")))


def summary(issues: DataFrame) -> DataFrame:
    """Findings by severity, all five severities present."""
    counts = issues.groupBy("severity").count()
    levels = issues.sparkSession.createDataFrame([(s, i) for i, s in enumerate(dims.SEVERITIES)], "severity string, rank int")
    return levels.join(counts, "severity", "left").select("severity", "rank", F.coalesce("count", F.lit(0)).alias("n"))


def result(created: DataFrame, issues: DataFrame) -> DataFrame:
    """section, name, n of a run: findings created, and the open issues in all, by severity (all five) and by category."""
    # the issues are counted once, by severity and category; all else adds these few rows up
    kinds = issues.filter("status = 'open'").groupBy("severity", "category").agg(F.count("*").alias("n"))
    row = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"))
    each = kinds.select(F.explode(F.array(row("total", F.lit("open"), F.col("n")), row("severity", F.col("severity"), F.col("n")), row("category", F.col("category"), F.col("n")))).alias("r")).select("r.*")
    always = [row("total", F.lit("open"), F.lit(0)), *[row("severity", F.lit(s), F.lit(0)) for s in dims.SEVERITIES]]
    zeros = issues.sparkSession.range(1).select(F.explode(F.array(*always)).alias("r")).select("r.*")
    all_ = created.agg(F.count("*").alias("n")).select(row("total", F.lit("created"), F.col("n")).alias("r")).select("r.*")
    return each.union(zeros).union(all_).groupBy("section", "name").agg(F.sum("n").alias("n"))


def list_issues(issues: DataFrame, items: DataFrame, limit: int = 500, severity: str | None = None, status: str = "all") -> DataFrame:
    """Issues with their item and the paired text: the most severe first, then the newest where issues have created_at."""
    if not 0 < limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    order = F.array_position(F.array(*map(F.lit, dims.SEVERITIES)), F.col("severity"))
    issues = issues if severity is None else issues.filter(F.col("severity") == severity)
    issues = issues if status == "all" else issues.filter(F.col("status") == status)
    newest = [F.desc("created_at")] if "created_at" in issues.columns else []
    top = issues.withColumn("rank", order).orderBy("rank", *newest, "fingerprint").limit(limit)  # limit before the joins
    a = items.select(F.col("id").alias("content_item_id"), "book_code", "chapter", "verse", "content_type", "current_text")
    b = items.select(F.col("id").alias("paired_content_item_id"), F.col("current_text").alias("paired_text"))
    return top.join(a, "content_item_id", "left").join(b, "paired_content_item_id", "left")
