"""Publishing, replacing, retiring: batch jobs that take table states and return the next ones."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import match_key, normalize_class
from rollbook.keyed import first_rows, last_wins, numbered
from rollbook.operators.versions import beyond_newest

BY = ("school_id",)


# ---------------------------------------------------------------- publishing a timetable: L1


def publish_routine(
    periods: DataFrame, resolved: DataFrame, summary: DataFrame, routines: DataFrame, as_of: date, effective: date | None = None, by: Sequence[str] = BY,
    known: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """L1: the drafts that pass the gate become the next version of their school.

    periods: draft rows (by, draft_id, ...); resolved: (by, raw, teacher_id); summary: (by, draft_id, publishable).
    known: stored subjects (by, subject_id, name); a printed subject whose name is one of them, whatever the case, keeps its id.
    Drafts of one school publish in draft order, so each takes the next number. Returns the new period, class,
    subject and day rows and the new state of the version table; a later effective date schedules the version."""
    gate = summary.filter("publishable").select(*by, "draft_id").distinct()
    top = routines.groupBy(*by).agg(F.max("version").alias("_top"))
    ranked = numbered(gate, by, ["draft_id"], "_n")
    versions = ranked.join(top, list(by), "left").select(*by, "draft_id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int").alias("version"))

    names = resolved.select(*by, F.col("raw").alias("_name"), "teacher_id")
    rows = periods.join(versions, [*by, "draft_id"]).withColumn("_name", F.trim("teacher_name")).join(names, [*by, "_name"], "left")
    lesson = ~F.col("is_break")
    period = rows.select(
        *by, "version", "draft_id", "seq", F.coalesce(normalize_class(F.col("class_name")), F.col("class_name")).alias("class_name"), "section", "day_idx", "slot",
        F.when(lesson, F.col("period_number")).alias("period_number"), "is_break", "start_time", "end_time", "subject",
        F.when(lesson & (F.trim("subject") != ""), match_key(F.col("subject"))).alias("subject_key"), F.when(lesson, F.col("teacher_id")).alias("teacher_id"), "teacher_name", "confidence",
        *[c for c in ("label", "room") if c in periods.columns],
    )
    classes = period.select(*by, "version", "class_name", "section").distinct()
    named = period.filter(F.col("subject_key").isNotNull())
    subjects = named.groupBy(*by, "subject_key").agg(F.min_by(F.trim("subject"), F.struct("version", "seq")).alias("name"))
    if known is not None:
        stored = known.select(*by, F.lower("name").alias("_lower"), "subject_id").groupBy(*by, "_lower").agg(F.min("subject_id").alias("subject_id"))
        subjects = subjects.withColumn("_lower", F.lower("name")).join(stored, [*by, "_lower"], "left").drop("_lower")
    days = period.select(*by, "day_idx").distinct()

    start = effective if effective is not None and effective > as_of else as_of
    scheduled = start > as_of
    new = versions.groupBy(*by).agg(F.max("version").alias("_new"))
    old = routines.join(new, list(by), "left")
    retire = F.col("_new").isNotNull() & ((F.col("status") == "ACTIVE") | ((F.col("status") == "SCHEDULED") & (F.col("effective_from") <= F.lit(as_of)))) & F.lit(not scheduled)
    changed = {"status": F.when(retire, F.lit("ARCHIVED")).otherwise(F.col("status")), "archived_on": F.when(retire, F.lit(as_of)).otherwise(F.col("archived_on"))}
    kept = old.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in routines.columns])
    live = F.lit("SCHEDULED") if scheduled else F.when(F.col("version") == F.col("_new"), F.lit("ACTIVE")).otherwise(F.lit("ARCHIVED"))
    stamp = F.lit(None).cast("date") if scheduled else F.when(F.col("version") != F.col("_new"), F.lit(as_of))
    # what the version table holds of its documents (title, session, doc_id) comes with the gate's rows
    told = [c for c in ("title", "session", "doc_id") if c in summary.columns and c in routines.columns]
    if told:
        versions = versions.join(summary.groupBy(*by, "draft_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in told]), [*by, "draft_id"], "left")
    published = [F.lit(as_of).alias("published_on")] if "published_on" in routines.columns else []
    added = versions.join(new, list(by)).select(*by, "version", F.lit(start).alias("effective_from"), live.alias("status"), stamp.alias("archived_on"), *told, *published)
    return {"period": period, "class": classes, "subject": subjects, "day": days, "routine": kept.unionByName(added, allowMissingColumns=True)}


# ---------------------------------------------------------------- upserts and replacements: L4-L7


def upsert_duties(existing: DataFrame, incoming: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """L4: one row per (date, teacher, kind); incoming rows win, later ones over earlier ones (`seq`).

    A stored row takes the incoming values and keeps its duty_id."""
    key = [*by, "duty_date", "teacher_id", "duty_type"]
    new = last_wins(incoming.filter(F.col("teacher_id").isNotNull()), key)
    kept = existing.join(new.select(*key), key, "left_anti")
    named = new.join(existing.select(*key, F.col("duty_id").alias("_id")), key, "left")
    return kept.unionByName(named.withColumn("duty_id", F.coalesce("_id", "duty_id")).select(*existing.columns))


def assign_duties(request: DataFrame) -> DataFrame:
    """L4: a request (dates array, teacher_ids array, ...) as one row per date and teacher."""
    out = request.withColumn("duty_date", F.explode(F.array_distinct("dates"))).withColumn("teacher_id", F.explode(F.array_distinct("teacher_ids")))
    return out.drop("dates", "teacher_ids")


def replace_range(existing: DataFrame, incoming: DataFrame, start: date, end: date, kinds: Sequence[str]) -> DataFrame:
    """A generated roster takes the place of the duties of its kinds in its dates."""
    replaced = F.col("duty_date").between(F.lit(start), F.lit(end)) & F.col("duty_type").isin(list(kinds))
    return existing.filter(~replaced).unionByName(incoming.select(*existing.columns))


def replace_per_teacher(existing: DataFrame, incoming: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """New weekly offs of a teacher replace all their old ones; a null day clears them. All columns of the stored rows are
    kept; what incoming rows do not hold is null in them."""
    new = incoming.filter(F.col("teacher_id").isNotNull()).select(*[c for c in existing.columns if c in incoming.columns]).distinct()
    kept = existing.join(new.select(*by, "teacher_id").distinct(), [*by, "teacher_id"], "left_anti").select(*existing.columns)
    return kept.unionByName(new.filter(F.col("day_idx").isNotNull()), allowMissingColumns=True)


def replace_active(existing: DataFrame, incoming: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A school's new list (extra classes, clubs) is live, what it had is kept but no longer live."""
    schools = incoming.select(*by).distinct().withColumn("_has", F.lit(True))
    old = existing.join(schools, list(by), "left")
    old = old.withColumn("active", F.col("active") & F.col("_has").isNull()).select(*existing.columns)
    return old.unionByName(incoming.withColumn("active", F.lit(True)).select(*existing.columns))


# ---------------------------------------------------------------- documents: J14, J15, L10, L14, L16, L17


def orphan_files(files: DataFrame, docs: DataFrame, key: str = "storage_key") -> DataFrame:
    """Stored files no document points at."""
    return files.join(docs.select(key), key, "left_anti")


def orphan_totals(files: DataFrame, docs: DataFrame, size: Column, key: str = "storage_key") -> DataFrame:
    """How many, and how many bytes."""
    return orphan_files(files, docs, key).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size.cast("long")), F.lit(0).cast("long")).alias("bytes"))


def documents_in_use(docs: DataFrame, routines: DataFrame, schedules: DataFrame, clubs: DataFrame, notices: DataFrame) -> DataFrame:
    """Documents with the reason they may not be deleted (null when they may). Sides hold doc_id and status,
    active or archived."""
    live = F.col("status").isin("ACTIVE", "SCHEDULED")
    r = routines.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(live).alias("live_routine"), F.max(F.col("status") == "ACTIVE").alias("active_routine"))
    lists = schedules.select("doc_id", "active").unionByName(clubs.select("doc_id", "active")).filter(F.col("doc_id").isNotNull())
    s = lists.groupBy("doc_id").agg(F.max("active").alias("live_list"))
    n = notices.filter(F.col("doc_id").isNotNull() & ~F.col("archived")).select("doc_id").distinct().withColumn("live_notice", F.lit(True))
    out = docs.join(r, "doc_id", "left").join(s, "doc_id", "left").join(n, "doc_id", "left")
    why = (
        F.when(F.col("extraction_status").isin("QUEUED", "PROCESSING", "REVIEW"), F.lit("in work"))
        .when(F.col("live_routine"), F.lit("current or upcoming routine"))
        .when(F.col("live_list"), F.lit("live schedule or club list"))
        .when(F.col("live_notice") & ~F.col("archived"), F.lit("attached to a notice"))
    )
    has = [F.col("live_routine").isNotNull().alias("has_routine"), F.col("live_list").isNotNull().alias("has_list"), F.coalesce("active_routine", F.lit(False)).alias("active_routine")]
    return out.select(*docs.columns, *has, why.alias("block_reason"))


def plan_documents(used: DataFrame, as_of: date, months: int) -> DataFrame:
    """What may be removed - ARCHIVED, JUNK, SUPERSEDED or OLD (only OLD is not preselected)."""
    old = F.col("created_on") < F.add_months(F.lit(as_of), -months)
    stale = F.col("updated_on") < F.date_sub(F.lit(as_of), 1)
    status = F.col("extraction_status")
    reason = (
        F.when(F.col("archived"), F.lit("ARCHIVED"))
        .when((status == "CANCELLED") | ((status == "FAILED") & stale), F.lit("JUNK"))
        .when(old & (F.col("kind") == "ROUTINE") & F.col("has_routine"), F.lit("SUPERSEDED"))
        .when(old & F.col("kind").isin("REMEDIAL", "CLUB") & F.col("has_list"), F.lit("SUPERSEDED"))
        .when(old, F.lit("OLD"))
    )
    out = used.filter(F.col("block_reason").isNull()).withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return out.withColumn("preselect", F.col("reason") != "OLD")


def document_kind_fix(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """File a document by what it held (counts: doc_id, draft_kind, periods, duties, remedial, clubs)."""
    out = docs.join(counts, "doc_id", "left")
    roster = F.col("kind").isin("ROUTINE", "REMEDIAL", "CLUB") & (F.col("periods") == 0) & (F.col("remedial") == 0) & (F.col("clubs") == 0) & (F.col("duties") > 0)
    extra = (F.col("draft_kind") == "REMEDIAL") & (F.col("kind") == "ROUTINE") & (F.col("remedial") > 0)
    fixed = F.when(roster, F.lit("OTHER")).when(extra, F.lit("REMEDIAL")).otherwise(F.col("kind"))
    return out.withColumn("kind", fixed).select(*docs.columns)


def transition_documents(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """Cancel, retry or save (actions: doc_id, action) applied where the state allows; others carry a problem.

    Returns doc_id, action, extraction_status (afterwards) and problem (null when done)."""
    d = docs.select("doc_id", "kind", F.col("extraction_status").alias("_now"))
    out = actions.join(d, "doc_id", "left")
    now, act = F.col("_now"), F.col("action")
    problem = (
        F.when(now.isNull(), F.lit("not found"))
        .when((act == "retry") & ~F.col("kind").isin("ROUTINE", "REMEDIAL", "CLUB"), F.lit("not extracted"))
        .when(act.isin("cancel", "retry") & (now == "PUBLISHED"), F.lit("already published"))
        .when((act == "retry") & (now == "PROCESSING"), F.lit("already running"))
        .when((act == "save") & ~now.isin("REVIEW", "FAILED"), F.lit("no longer editable"))
        .when(~act.isin("cancel", "retry", "save"), F.lit("unknown action"))
    )
    after = F.when(act == "cancel", F.lit("CANCELLED")).when(act == "retry", F.lit("QUEUED")).otherwise(F.lit("REVIEW"))
    return out.select("doc_id", "action", F.when(problem.isNull(), after).otherwise(now).alias("extraction_status"), problem.alias("problem"))


def archive_documents(used: DataFrame, actions: DataFrame) -> DataFrame:
    """Archive, restore or delete (actions: doc_id, action) with what comes of it: done or refused with a reason."""
    out = actions.join(used.select("doc_id", "active_routine", "block_reason"), "doc_id")
    act = F.col("action")
    refused = F.when((act == "archive") & F.col("active_routine"), F.lit("active routine")).when(act == "delete", F.col("block_reason"))
    return out.select("doc_id", "action", refused.isNull().alias("done"), refused.alias("refusal"))


def delete_documents(docs: DataFrame, decided: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Documents left after the permitted deletes, and their drafts, logs and files with them."""
    gone = decided.filter((F.col("action") == "delete") & F.col("done")).select("doc_id").distinct()
    return {"document": docs.join(gone, "doc_id", "left_anti"), **{n: df.join(gone, "doc_id", "left_anti") for n, df in children.items()}}


# ---------------------------------------------------------------- retention: L11


def plan_retention(
    routines: DataFrame, periods: DataFrame, duties: DataFrame, notices: DataFrame, drafts: DataFrame, as_of: date, months: int, by: Sequence[str] = BY
) -> DataFrame:
    """Rows (and bytes of raw text) a clean-up would remove per school, one line per item."""
    cutoff = F.add_months(F.lit(as_of), -months)
    old = beyond_newest(routines, cutoff, by=by).select(*by, "version")
    done = F.col("text").isNotNull() & F.col("extraction_status").isin("PUBLISHED", "CANCELLED", "FAILED")

    def counted(df: DataFrame, item: str, size: Column | None = None) -> DataFrame:
        size = F.lit(0) if size is None else size
        return df.select(*by, F.lit(item).alias("item"), size.cast("long").alias("_b")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("rows"), F.sum("_b").alias("bytes"))

    parts = [
        counted(old, "routines"),
        counted(periods.join(old, [*by, "version"], "left_semi"), "periods"),
        counted(duties.filter(F.col("duty_date") < cutoff), "duties"),
        counted(notices.filter(F.col("archived") & (F.col("notice_date") < cutoff)), "notices"),
        counted(drafts.filter(done), "draft text", F.octet_length("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge_routines(routines: DataFrame, periods: DataFrame, as_of: date, months: int, by: Sequence[str] = BY) -> dict[str, DataFrame]:
    """Version and period tables without the versions past roll-back."""
    old = beyond_newest(routines, F.add_months(F.lit(as_of), -months), by=by).select(*by, "version")
    return {"routine": routines.join(old, [*by, "version"], "left_anti"), "period": periods.join(old, [*by, "version"], "left_anti")}


def purge_dated(df: DataFrame, day: str, as_of: date, months: int, only: Column | None = None) -> DataFrame:
    """Rows kept when those before the cutoff (and matching `only`) go."""
    gone = F.col(day) < F.add_months(F.lit(as_of), -months)
    return df.filter(~(gone if only is None else gone & only))


def trim_draft_text(drafts: DataFrame) -> DataFrame:
    """Raw text of finished drafts becomes null."""
    return drafts.withColumn("text", F.when(~F.col("extraction_status").isin("PUBLISHED", "CANCELLED", "FAILED"), F.col("text")))


# ---------------------------------------------------------------- versions, layouts, people, patches: L13, L15, L18, L19


def copy_layout(periods: DataFrame, source: tuple[str, str], target: tuple[str, str], by: Sequence[str] = BY) -> DataFrame:
    """The target class takes slots and times by period number from the source class, and its breaks on each of
    its own days (or the source's days when it has none). Other classes are untouched.

    A set start or end is taken from the first row of the slot that has one."""
    pick = lambda c: (F.col("class_name") == c[0]) & (F.col("section") == c[1])
    src, own = periods.filter(pick(source)), periods.filter(pick(target))
    first = F.col("seq")
    cols = src.groupBy(*by, "slot").agg(
        F.min_by("period_number", first).alias("number"), F.min_by("is_break", first).alias("brk"), F.min_by("label", first).alias("lab"),
        F.min_by("start_min", F.when(F.col("start_min").isNotNull(), first)).alias("s"), F.min_by("end_min", F.when(F.col("end_min").isNotNull(), first)).alias("e"),
    )
    by_number = cols.filter(~F.col("brk") & F.col("number").isNotNull()).groupBy(*by, "number").agg(F.max(F.struct("slot", "s", "e")).alias("c"))
    by_number = by_number.select(*by, F.col("number").alias("period_number"), "c")
    lessons = own.filter(~F.col("is_break")).join(by_number, [*by, "period_number"], "left")
    moved = F.col("c").isNotNull()
    lessons = lessons.withColumn("slot", F.coalesce("c.slot", "slot")).withColumn("start_min", F.when(moved, F.col("c.s")).otherwise(F.col("start_min")))
    lessons = lessons.withColumn("end_min", F.when(moved, F.col("c.e")).otherwise(F.col("end_min")))

    own_days = own.select(*by, "day_idx").distinct()
    src_days = src.select(*by, "day_idx").distinct().join(own.select(*by).distinct(), list(by), "left_anti")
    days = own_days.unionByName(src_days)
    breaks = cols.filter("brk").join(days, list(by))
    values = {
        "class_name": F.lit(target[0]), "section": F.lit(target[1]), "slot": F.col("slot"), "is_break": F.lit(True), "label": F.coalesce("lab", F.lit("BREAK")),
        "start_min": F.col("s"), "end_min": F.col("e"), "subject": F.lit(""), "day_idx": F.col("day_idx"),
    }
    types = {f.name: f.dataType for f in periods.schema}
    breaks = breaks.select(*[F.col(c) if c in by else values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in periods.columns])
    changed = cols.select(*by).distinct()
    untouched = periods.filter(~pick(target)).unionByName(own.join(changed, list(by), "left_anti"))
    return untouched.unionByName(lessons.join(changed, list(by), "left_semi").select(*periods.columns)).unionByName(breaks)


def deactivate_people(users: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Logins of people who are no longer active are switched off."""
    off = people.filter(~F.col("active")).select(*by, "teacher_id").withColumn("_off", F.lit(True))
    return users.join(off, [*by, "teacher_id"], "left").withColumn("active", F.col("active") & F.col("_off").isNull()).drop("_off")


def switch_version(routines: DataFrame, actions: DataFrame, as_of: date, by: Sequence[str] = BY) -> DataFrame:
    """Activate, archive or delete a version (actions: by, version, action; one activation per school).

    Activating archives the current one; the active version cannot be deleted."""
    act = first_rows(actions, [*by, "version"], F.col("action"))
    on = act.filter("action = 'activate'").select(*by, F.col("version").alias("_on")).groupBy(*by).agg(F.max("_on").alias("_on"))
    out = routines.join(act, [*by, "version"], "left").join(on, list(by), "left")
    wins = F.col("version") == F.col("_on")
    retired = (F.col("_on").isNotNull() & (F.col("status") == "ACTIVE") & ~wins) | (F.coalesce("action", F.lit("")) == "archive")
    out = out.filter(~((F.coalesce("action", F.lit("")) == "delete") & (F.col("status") != "ACTIVE")))
    changed = {
        "effective_from": F.when(wins, F.lit(as_of)).otherwise(F.col("effective_from")),
        "status": F.when(wins, F.lit("ACTIVE")).when(retired, F.lit("ARCHIVED")).otherwise(F.col("status")),
        "archived_on": F.when(wins, F.lit(None).cast("date")).when(retired, F.lit(as_of)).otherwise(F.col("archived_on")),
    }
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in routines.columns])


def apply_patches(df: DataFrame, patches: DataFrame, keys: Sequence[str], fields: Sequence[str], fixed: dict[str, Column] | None = None) -> DataFrame:
    """Patch rows hold the keys, a `set_fields` array of the names they set, and the values.

    A field not named is kept; a named one is set, to null too. `fixed` adds columns worked out afterwards
    (e.g. the teacher's name when the teacher changes); they may use `patched(name)`."""
    p = patches.select(*keys, F.col("set_fields").alias("_set"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    out = df.join(p, list(keys), "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(F.array_contains("_set", f), F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)))
    for name, value in (fixed or {}).items():
        out = out.withColumn(name, value)
    return out.drop("_set", *[f"_new_{f}" for f in fields])


def patched(field: str) -> Column:
    """Whether the row's patch sets the field; for `fixed` columns of `apply_patches`."""
    return F.coalesce(F.array_contains("_set", field), F.lit(False))
