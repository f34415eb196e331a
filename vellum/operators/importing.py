"""Import of canonical items: duplicate files, classification, conflicts, resolution.

An import goes record by record, in order of (sequence_no, id).  A row is held against the row that has its
logical key, else against the newest row with its match key and language, if their resource roles may
stand in for each other; a row without either is inserted, and from then on is the newest of its match key,
so that it can hide an older row from those that follow, and the only one of its logical key.

Whether a row is inserted thus depends on earlier rows.  Of the newest row only its role's class counts, so
a match key is a small automaton.  Keys with few rows whose logical keys stay inside go through it in one
sorted stream; longer ones are cut into pieces whose effects on the five classes are chained; where a
logical key occurs under several match keys, this is repeated with what it tells until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import dims
from vellum.functions import text as T
from vellum.operators import scans


def resolve_language(items: DataFrame, source_code: str | None, target_code: str | None) -> DataFrame:
    """language_role and language_code of items whose file has `file_language` and `resource_role`."""
    src, tgt, given = F.lit(source_code), F.lit(target_code), F.nullif("file_language", F.lit(""))
    own = F.col("language_role")
    role = F.coalesce(
        own,
        F.when(F.col("resource_role").rlike("^source(_|$)"), "source").when(F.col("resource_role").rlike("^target(_|$)"), "target").when(given == src, "source").when(given == tgt, "target"),
    )
    code = F.when(own == "source", F.coalesce(src, given)).when(own == "target", F.coalesce(tgt, given)).otherwise(given)
    code = F.coalesce(code, F.when(role == "source", src).when(role == "target", tgt))
    return items.withColumns({"language_role": role, "language_code": code})


def logical_key(items: DataFrame) -> Column:
    return F.concat_ws("|", "resource_role", F.coalesce("language_code", F.lit("")), "semantic_key")


def may_stand_in(content_type: Column, a: Column, b: Column) -> Column:
    """Whether records of two resource roles may be held against each other."""
    inside = lambda r: r.isin("source_scripture", "target_scripture")
    own = F.when(content_type == "footnote", "footnotes").when(content_type == "cross_reference", "cross_references").when(content_type == "section_heading", "study_notes")
    return F.coalesce(((a == own) & inside(b)) | ((b == own) & inside(a)), F.lit(False))


def recommendation(content_type: Column, protection: Column, old: Column, new: Column) -> Column:
    scripture = (protection == "protected_scripture") | content_type.isin("scripture", "scripture_fragment")
    return F.when(scripture, "manual_review").when(new > old, "use_incoming").when(new < old, "keep_existing").otherwise("manual_review")


# Why a recommendation is given; {0} a resource role, {1} and {2} priorities.
REASONS = {
    "scripture": "Scripture changes always require explicit human review. Authority priority never auto-accepts a Scripture change.",
    "use_incoming": "Incoming {0} resource has higher configured authority ({1} > {2}). Human confirmation is still required.",
    "keep_existing": "Existing {0} resource has higher configured authority ({1} > {2}).",
    "manual_review": "Existing and incoming resources have equal or unspecified authority. Compare the content manually.",
}


def authority_reason(content_type: Column, protection: Column, old_role: Column, new_role: Column, old: Column, new: Column) -> Column:
    """The sentence that goes with `recommendation`."""

    def told(name: str, role: Column, more: Column, less: Column) -> Column:
        said = F.lit(REASONS[name])
        for k, v in enumerate((role, more.cast("string"), less.cast("string"))):
            said = F.replace(said, F.lit(f"{{{k}}}"), v)
        return said

    choice = recommendation(F.lit(""), F.lit(""), old, new)
    scripture = recommendation(content_type, protection, F.lit(0), F.lit(1)) == "manual_review"
    return F.when(scripture, REASONS["scripture"]).when(choice == "use_incoming", told("use_incoming", new_role, new, old)).when(choice == "keep_existing", told("keep_existing", F.coalesce(old_role, F.lit("unknown")), old, new)).otherwise(REASONS["manual_review"])


def authority_rules(spark, items: DataFrame | None = None) -> DataFrame:
    """All rules by type, the highest priority first; with items: how many each rule concerns."""
    rules = dims.authority(spark)
    if items is not None:
        counts = items.groupBy("content_type", "resource_role").agg(F.count("*").alias("n_items"))
        rules = rules.join(counts, ["content_type", "resource_role"], "left").fillna(0, ["n_items"])
    return rules.orderBy("content_type", F.desc("priority"), "resource_role")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (content, resource_role, language_code) whose bytes are not stored yet for that role and language.

    Runs before any parsing; a null language counts as empty.
    """
    lang = F.coalesce("language_code", F.lit(""))
    files = files.withColumn("sha256", F.sha2("content", 256)).withColumn("_lang", lang)
    known = known.select("sha256", "resource_role", lang.alias("_lang"))
    return files.join(known, ["sha256", "resource_role", "_lang"], "left_anti").drop("_lang")


#: The standalone role of each content type that is matched across roles; embedded ones have a scripture role.
OWN_ROLE = {"footnote": "footnotes", "cross_reference": "cross_references", "section_heading": "study_notes"}
_INSIDE = ("source_scripture", "target_scripture")
_CLASSES = ("footnotes", "cross_references", "study_notes", "scripture", "other")
_ANCHOR = "struct<id: string, content_hash: string, resource_role: string, protection_level: string>"


def role_class(role: str | None) -> str:
    return "scripture" if role in _INSIDE else role if role in _CLASSES[:3] else "other"


def _stands_in(row: dict, newest: str) -> bool:
    """Whether a row may be held against a newest row whose role is of that class."""
    own, mine = OWN_ROLE.get(row["content_type"]), role_class(row["resource_role"])
    return own is not None and {mine, newest} == {own, "scripture"}


def _anchor_of(row: dict) -> dict:
    return {c: row[c] for c in ("id", "content_hash", "resource_role", "protection_level")}


def _through(rows: list[dict], newest: dict | None, out: list | None = None, within: bool = False) -> dict | None:
    """The newest row behind the rows of one match key, given the newest before them.

    out gets id, inserted and mate (the row it is held against by its match key).  within: a logical key
    that was inserted here anchors the rows that follow, else `blocked` tells this.
    """
    inserted = set()
    for row in rows:
        mate = None
        if row["logical_key"] in inserted if within else row["blocked"]:
            new = False
        elif newest and _stands_in(row, newest["class"]):
            new, mate = False, newest["row"]
        else:
            new, newest = True, {"class": role_class(row["resource_role"]), "row": _anchor_of(row)}
            inserted.add(row["logical_key"])
        if out is not None:
            out.append({"id": row["id"], "inserted": new, "mate": mate})
    return newest


def _before(rows: list[dict], state: dict | None) -> dict | None:
    """The newest row before a group's first piece is the stored one."""
    near = rows[0]["near"]
    return state if state is not None else {"class": role_class(near["resource_role"]), "row": near} if near else None


def _effect(rows: list[dict]) -> dict:
    """The newest row behind a piece for each class of the newest before it (null: that one), and the group's first state."""
    return {"start": _before(rows, None), "then": {c: None if (x := _through(rows, {"class": c, "row": None}))["row"] is None else x for c in _CLASSES}}


def _advance(state: dict | None, effect: dict) -> dict | None:
    state = state if state is not None else effect["start"]
    return effect["then"][state["class"] if state else "other"] or state


_DECIDED = f"id string, inserted boolean, mate {_ANCHOR}"


def _whole_groups(rows: DataFrame) -> DataFrame:
    """id, inserted, mate of small groups to which no other row's decision matters; one sorted stream."""

    def run(stream: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(stream, lambda r: (r["match_key"], r["lang"])):
            held, out = list(own), []
            _through(held, _before(held, None), out, within=True)
            yield from out

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scans.mapped(rows.repartition(n, "match_key", "lang").sortWithinPartitions("match_key", "lang", "sequence_no", "id"), run, _DECIDED)


def _chained_groups(rows: DataFrame, few: int) -> DataFrame:
    """id, inserted, mate of groups of any size, in pieces of `few` rows, where `blocked` tells which rows an earlier one with their logical key anchors."""

    def finish(held: list[dict], state: dict | None) -> Iterator[dict]:
        out: list = []
        _through(held, _before(held, state), out)
        yield from out

    keys = ["match_key", "lang"]
    cut = scans.pieces(rows, keys, ["sequence_no", "id"], few)
    return scans.finished(cut, scans.start_states(cut, keys, _effect, _advance), finish, _DECIDED)


def _first_inserted(decided: DataFrame) -> DataFrame:
    """logical_key, at, first (as an anchor) of the first inserted row."""
    at = F.struct("sequence_no", "id")
    anchor = F.struct("id", "content_hash", "resource_role", "protection_level")
    return decided.filter("inserted").groupBy("logical_key").agg(F.min(at).alias("at"), F.min_by(anchor, at).alias("first"))


def _hidden_apart(rows: DataFrame, fits: Column, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without a stored logical anchor, by what decides them: nothing but the stored rows, a small group
    of their own, anything else."""
    groups = rows.filter("match_key IS NOT NULL").groupBy("match_key", "lang").agg(F.count("*").alias("n"), F.bool_or(F.col("content_type").isin(*OWN_ROLE)).alias("open")).filter("n > 1 AND open").drop("open")
    rows = rows.withColumn("fits", fits).join(groups, ["match_key", "lang"], "left")
    under = F.struct("match_key", "lang")
    spread = rows.groupBy("logical_key").agg(F.min(under).alias("lo"), F.max(under).alias("hi"), F.bool_or(F.col("n").isNotNull()).alias("open")).filter("open AND lo <> hi").select("logical_key", F.lit(True).alias("_spread"))
    # one spread key makes its whole group depend on others
    rows = rows.join(spread, "logical_key", "left")
    groups_spread = rows.filter("_spread AND n IS NOT NULL").select("match_key", "lang").distinct().withColumn("_tied", F.lit(True))
    rows = rows.join(groups_spread, ["match_key", "lang"], "left").drop("_spread")
    tied = F.coalesce("_tied", F.lit(False)) | (F.col("n") > few)
    return rows.filter("n IS NULL").drop("n", "_tied"), rows.filter(F.col("n").isNotNull() & ~tied).drop("n", "_tied"), rows.filter(F.col("n").isNotNull() & tied).drop("n", "_tied")


def in_batch(rows: DataFrame, fits: Column, few: int) -> DataFrame:
    """rows (without a stored logical anchor, with the newest stored row of their match key as `near`) with
    inserted, mate and first: what an import in order of (sequence_no, id) holds them against."""
    plain, small, tied = _hidden_apart(rows, fits, few)
    plain = plain.select(*rows.columns, (~F.col("fits")).alias("inserted"), F.when(F.col("fits"), F.col("near")).alias("mate"))
    small = small.join(_whole_groups(small), "id").select(*plain.columns)
    decided = plain.union(small)
    tied = scans.kept(tied)
    if not tied.isEmpty():
        at = F.struct("sequence_no", "id")
        first = _first_inserted(decided.union(tied.select(*rows.columns, F.lit(True).alias("inserted"), F.col("near").alias("mate"))))
        while True:
            blocked = scans.kept(tied.join(first.select("logical_key", "at"), "logical_key", "left").withColumn("blocked", F.coalesce(at > F.col("at"), F.lit(False))).drop("at"))
            done = scans.kept(blocked.join(_chained_groups(blocked.select("match_key", "lang", "sequence_no", "id", "logical_key", "content_type", "resource_role", "content_hash", "protection_level", "near", "blocked"), few), "id"))
            first = scans.kept(_first_inserted(decided.union(done.select(*plain.columns))))
            # right once the keys that the decisions give are those they were made with
            if done.join(first.select("logical_key", "at"), "logical_key", "left").filter(F.coalesce(at > F.col("at"), F.lit(False)) != F.col("blocked")).isEmpty():
                break
        decided = decided.union(done.select(*plain.columns))
    # rows behind the first inserted one of their logical key are held against it, whatever their match key says
    out = decided.join(_first_inserted(decided), "logical_key", "left")
    behind = F.coalesce(F.struct("sequence_no", "id") > F.col("at"), F.lit(False))
    return out.withColumns({"mate": F.when(~behind, F.col("mate")), "first": F.when(behind, F.col("first"))}).drop("at", "inserted")


def classify(incoming: DataFrame, existing: DataFrame, within: bool = True, few: int = scans.PIECE) -> DataFrame:
    """incoming with status (new, identical, conflict), cross_role, anchor_id and the recommendation.

    Both sides are canonical items with id and logical_key; existing has created_at.  Every inserted row is
    newer than all that is stored.  within=False holds each row against the stored ones alone, as a preview
    does.  A match key with more than `few` rows is cut into pieces of that size; the result is the same.
    """
    spark = incoming.sparkSession
    inc = incoming.select("id", "logical_key", "match_key", F.coalesce("language_code", F.lit("")).alias("lang"), "resource_role", "content_type", "content_hash", "sequence_no", F.coalesce("protection_level", F.lit("normal")).alias("protection_level"))
    one = F.struct(F.col("id"), "content_hash", "resource_role", "protection_level")
    by_key = existing.groupBy("logical_key").agg(F.min_by(one, "id").alias("same"))
    lang = F.coalesce("language_code", F.lit("")).alias("lang")
    newest = existing.groupBy("match_key", lang).agg(F.max_by(one, F.struct("created_at", "id")).alias("near"))
    rows = inc.join(by_key, "logical_key", "left").join(newest, ["match_key", "lang"], "left")
    near = F.col("near")
    fits = F.coalesce(F.col("content_type").isin(*dims.MATCHED_TYPES) & (near["resource_role"] != F.col("resource_role")) & may_stand_in(F.col("content_type"), near["resource_role"], F.col("resource_role")), F.lit(False))
    if within:
        rows = scans.kept(rows)  # keys and hashes only
        apart = in_batch(rows.filter("same IS NULL"), fits, few)
        rows = rows.filter("same IS NOT NULL").withColumns({"mate": F.lit(None).cast(_ANCHOR), "first": F.lit(None).cast(_ANCHOR)}).unionByName(apart)
    else:
        rows = rows.withColumns({"mate": F.when(F.col("same").isNull() & fits, near), "first": F.lit(None).cast(_ANCHOR)})
    rows = rows.withColumns({"cross_role": F.col("mate").isNotNull(), "anchor": F.coalesce("same", "mate", "first")})
    anchor = F.col("anchor")
    status = F.when(anchor.isNull(), "new").when(anchor["content_hash"] == F.col("content_hash"), "identical").otherwise("conflict")
    rules = dims.authority(spark)
    old = F.broadcast(rules.select("content_type", F.col("resource_role").alias("old_role"), F.col("priority").alias("old")))
    new = F.broadcast(rules.select("content_type", "resource_role", F.col("priority").alias("new")))
    rows = rows.withColumns({"status": status, "old_role": anchor["resource_role"]}).join(old, ["content_type", "old_role"], "left").join(new, ["content_type", "resource_role"], "left")
    told = [F.col("content_type"), anchor["protection_level"]]
    old, new = F.coalesce("old", F.lit(0)), F.coalesce("new", F.lit(0))
    is_conflict = F.col("status") == "conflict"
    return rows.select(
        "id", "logical_key", "match_key", "content_type", "resource_role", "sequence_no", "status", "cross_role", anchor["id"].alias("anchor_id"), "old_role",
        (anchor["protection_level"] == "protected_scripture").alias("protected"), F.when(is_conflict, recommendation(*told, old, new)).alias("recommendation"),
        F.when(is_conflict, authority_reason(*told, F.col("old_role"), F.col("resource_role"), old, new)).alias("reason"),
    )


def summarize(classified: DataFrame) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return classified.agg(
        is_("status", "new").alias("new_items"), is_("status", "identical").alias("exact_items"), is_("status", "conflict").alias("changed_items"), F.count_if("cross_role").alias("overlaps"),
        is_("recommendation", "use_incoming").alias("recommended_incoming"), is_("recommendation", "keep_existing").alias("recommended_existing"), is_("recommendation", "manual_review").alias("manual_review"),
    )


def preview(incoming: DataFrame, existing: DataFrame, examples: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an import would do: counts (see summarize), items by language role, and the first conflicts with the reason."""
    sorted_out = classify(incoming, existing, within=False)
    shown = sorted_out.filter("status = 'conflict'").orderBy("sequence_no", "id").limit(examples)
    shown = shown.select("id", "match_key", "content_type", F.col("old_role").alias("existing_role"), F.col("resource_role").alias("incoming_role"), "recommendation", "reason", F.col("protected").alias("protected_scripture"))
    return summarize(sorted_out), language_breakdown(incoming), shown


def language_breakdown(items: DataFrame) -> DataFrame:
    """language_role, n; the roles source, target, auxiliary and unassigned (none given) are always there."""
    counts = items.groupBy(F.coalesce("language_role", F.lit("unassigned")).alias("language_role")).agg(F.count("*").alias("n"))
    known = items.sparkSession.createDataFrame([(r, 0) for r in ("source", "target", "auxiliary", "unassigned")], "language_role string, n long")
    return counts.union(known).groupBy("language_role").agg(F.sum("n").alias("n"))


def commit(incoming: DataFrame, existing: DataFrame, sorted_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the items, and the pending conflicts; sorted_out: the rows as classify has given them before.

    Where incoming rows tell their resource_id, file_id, source_locator and created_at, the conflicts carry them on.
    """
    sorted_out = classify(incoming, existing) if sorted_out is None else sorted_out
    inserted = incoming.join(sorted_out.filter("status = 'new'").select("id"), "id", "left_semi")
    carried = {"resource_id": "incoming_resource_id", "file_id": "incoming_file_id", "source_locator": "source_locator", "created_at": "created_at"}
    own = [F.col(c).alias(name) if c in incoming.columns else F.lit(None).cast("string").alias(name) for c, name in carried.items()]
    conflicts = sorted_out.filter("status = 'conflict'").join(incoming.select("id", F.col("current_text").alias("incoming_text"), F.col("raw_text").alias("incoming_raw_text"), *own), "id")
    conflicts = conflicts.select(
        F.sha2(F.concat_ws("|", "id", "anchor_id"), 256).alias("conflict_id"), F.col("id").alias("incoming_id"), "anchor_id", "content_type", F.col("resource_role").alias("incoming_role"), F.col("old_role").alias("existing_role"),
        "recommendation", "reason", "incoming_text", "incoming_raw_text", *carried.values(), F.lit("pending").alias("status"),
    )
    return inserted, conflicts


def committed_books(incoming: DataFrame, books: DataFrame) -> DataFrame:
    """The books of incoming rows that are not there yet."""
    seen = incoming.filter("book_code <> ''").select("book_code").distinct()
    return seen.join(books.select("book_code"), "book_code", "left_anti")


def committed_resources(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """A resource for each file, with a language unless the file mixes source and target, and a book if it has only one."""
    flag = lambda role: F.coalesce(F.bool_or(F.col("language_role") == role), F.lit(False))
    whose = incoming.groupBy("file_id").agg((flag("source") & flag("target")).alias("mixed"), F.min(F.nullif("book_code", F.lit(""))).alias("lo"), F.max(F.nullif("book_code", F.lit(""))).alias("hi"))
    return files.join(whose, "file_id", "left").select(
        "file_id", "resource_role", F.when(~F.coalesce("mixed", F.lit(False)), F.nullif("language_code", F.lit(""))).alias("language_code"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("book_code"), F.col("filename").alias("title")
    )


def committed_batches(files: DataFrame, incoming: DataFrame, sorted_out: DataFrame) -> DataFrame:
    """The rows of the batches themselves, with what became of their items."""
    state = sorted_out.join(incoming.select("id", "file_id"), "id").join(files.select("file_id", "batch_id"), "file_id")
    count = lambda status: F.count_if(F.col("status") == status)
    batches = state.groupBy("batch_id").agg(count("new").alias("inserted"), count("identical").alias("skipped"), count("conflict").alias("changed"), F.count_if("cross_role").alias("overlaps"))
    return files.select("batch_id").distinct().join(batches, "batch_id", "left").fillna(0).withColumn("status", F.lit("committed"))


def committed(files: DataFrame, incoming: DataFrame, existing: DataFrame, books: DataFrame, sorted_out: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a committed batch adds beside its items and conflicts: books, resources, and the batches' own rows.

    files: file_id, batch_id, filename, language_code, resource_role; incoming rows tell their file_id.
    """
    sorted_out = classify(incoming, existing) if sorted_out is None else sorted_out
    return {"books": committed_books(incoming, books), "resources": committed_resources(files, incoming), "batches": committed_batches(files, incoming, sorted_out)}


def conflict_rollup(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("incoming_role", "recommendation").agg(F.count("*").alias("n"))


def list_conflicts(conflicts: DataFrame, items: DataFrame, status: str = "pending", resources: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Conflicts with the stored record, those to accept first, then the newest.

    resources (resource_id, title) names the stored record's resource, files (file_id, filename) the incoming file.
    """
    rank = F.when(F.col("recommendation") == "use_incoming", 1).when(F.col("recommendation") == "manual_review", 2).otherwise(3)
    chosen = conflicts if status == "all" else conflicts.filter(F.col("status") == status)
    more = {"raw_text": "existing_raw_text", "marker": "existing_marker", "category": "existing_category", "review_status": "review_status", "resource_id": "existing_resource_id"}
    stored = items.select(F.col("id").alias("anchor_id"), F.col("current_text").alias("existing_text"), "book_code", "chapter", "verse", "protection_level", *[F.col(c).alias(name) for c, name in more.items() if c in items.columns])
    rows = chosen.join(stored, "anchor_id")
    if resources is not None:
        rows = rows.join(resources.select(F.col("resource_id").alias("existing_resource_id"), F.col("title").alias("existing_resource")), "existing_resource_id", "left")
    if files is not None:
        rows = rows.join(files.select(F.col("file_id").alias("incoming_file_id"), F.col("filename").alias("incoming_filename")), "incoming_file_id", "left")
    return rows.withColumn("rank", rank).orderBy("rank", F.desc("created_at"), "conflict_id")


def resolve(conflicts: DataFrame, items: DataFrame, versions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Next state of items, conflicts and versions, and the decisions that were refused with the reason.

    decisions: conflict_id, action (keep_existing, use_incoming, manual_merge), reason, merged_text,
    confirm_protected, and if wanted actor and decided_at.  One decision for a conflict; several for one
    item apply in conflict_id order.  A changed item takes over the incoming resource, file and locator
    where these are known; a decided conflict says by whom, when and why.
    """
    decisions = decisions if "actor" in decisions.columns else decisions.withColumn("actor", F.lit("Human editor"))
    decisions = decisions if "decided_at" in decisions.columns else decisions.withColumn("decided_at", F.current_timestamp())
    stored = items.select(F.col("id").alias("anchor_id"), "protection_level", F.col("current_text").alias("existing_text"), F.lit(True).alias("_held"))
    rows = decisions.join(conflicts.withColumnRenamed("reason", "advice"), "conflict_id", "left").join(stored, "anchor_id", "left")
    changes = F.col("action").isin("use_incoming", "manual_merge")
    error = (
        F.when(~F.coalesce(changes | (F.col("action") == "keep_existing"), F.lit(False)), "invalid action")
        .when(F.col("_held").isNull(), "conflict not found")
        .when(F.col("status") != "pending", "already resolved")
        .when(changes & (F.col("protection_level") == "protected_scripture") & ~F.coalesce("confirm_protected", F.lit(False)), "protected text needs confirmation")
        .when(changes & T.is_blank(F.col("reason")), "a reason is required")
        .when((F.col("action") == "manual_merge") & T.is_blank(F.col("merged_text")), "merged text is required")
    )
    rows = rows.withColumn("error", error)
    good, refused = rows.filter("error IS NULL"), rows.filter("error IS NOT NULL").select("conflict_id", "action", "error")
    changed = good.filter(changes).withColumns({"text": F.when(F.col("action") == "manual_merge", F.col("merged_text")).otherwise(F.col("incoming_text")), "raw": F.when(F.col("action") == "manual_merge", F.col("merged_text")).otherwise(F.col("incoming_raw_text"))})
    order = Window.partitionBy("anchor_id").orderBy("conflict_id")
    last = versions.groupBy(F.col("content_item_id").alias("anchor_id")).agg(F.max("revision_no").alias("last"))
    revisions = changed.join(last, "anchor_id", "left").select(
        F.col("anchor_id").alias("content_item_id"), (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int").alias("revision_no"),
        F.coalesce(F.lag("text").over(order), "existing_text").alias("text"), F.col("action").alias("change_type"), "reason",
    )
    moved = {"resource_id": "incoming_resource_id", "source_file_id": "incoming_file_id", "source_locator": "source_locator"}
    moved = {c: name for c, name in moved.items() if c in items.columns and name in conflicts.columns}
    # each of them from the last decision that tells it
    newest = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("conflict_id"))).alias(f"_{c}") for c, name in moved.items()]
    final = changed.groupBy("anchor_id").agg(F.max_by(F.struct("text", "raw"), "conflict_id").alias("_new"), *newest).withColumnRenamed("anchor_id", "id")
    touched = F.col("_new").isNotNull()
    pick = lambda new, old: F.when(touched, new).otherwise(F.col(old))
    next_items = items.join(final, "id", "left").withColumns(
        {"current_text": pick(F.col("_new.text"), "current_text"), "raw_text": pick(F.col("_new.raw"), "raw_text"), "content_hash": pick(T.content_hash(F.col("_new.text")), "content_hash"), "review_status": pick(F.lit("needs_review"), "review_status")}
        | {c: F.coalesce(F.col(f"_{c}").cast(items.schema[c].dataType), F.col(c)) for c in moved}
    )
    taken = good.select("conflict_id", F.col("action").alias("_action"), F.nullif("reason", F.lit("")).alias("resolution_reason"), F.col("actor").alias("resolved_by"), F.col("decided_at").alias("resolved_at"))
    next_conflicts = conflicts.join(taken, "conflict_id", "left").withColumn("status", F.coalesce("_action", "status")).drop("_action")
    return next_items.select(*items.columns), next_conflicts, versions.unionByName(revisions), refused
