"""Comparing snapshots, folders and ledgers; applying changes as DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..config import Settings
from .reports import trim_history
from .scale import is_false, is_true, row_numbers, running_total

LIFECYCLE = {
    "reviewed": ("marked reviewed", "unmarked reviewed"),
    "logged": ("marked logged to sheet", "unmarked logged to sheet"),
    "archived": ("archived", "restored from archive"),
    "rejected": ("marked rejected", "rejection cleared"),
}


# ---- folders ------------------------------------------------------------------------------------------

def incremental_pull(
    listing: DataFrame, cursor: Column, handled: DataFrame, pending: DataFrame, ledger: DataFrame
) -> DataFrame:
    """Files added since the cursor that are not handled, pending or an unchanged copy of our own.

    listing: path, size, mtime, added (latest of its times), sha1. handled, pending: file_key.
    ledger: path, size, sha1.
    """
    key = F.concat_ws("|", F.lower("path"), F.col("size"), F.unix_millis(F.col("mtime").cast("timestamp")))
    fresh = listing.where(F.col("added") > cursor).withColumn("file_key", key)
    fresh = fresh.join(handled.select("file_key"), "file_key", "left_anti").join(
        pending.select("file_key"), "file_key", "left_anti"
    )
    own = ledger.select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("sha1").alias("__h"))
    mine = (F.lower("path") == F.lower("__p")) & (F.col("size") == F.col("__s")) & (F.col("sha1") == F.col("__h"))
    return fresh.join(own, mine, "left_anti")


def ledger_status(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, status): foreign, changed, clearable, or dropped when a ledger file is gone."""
    l = ledger.select("path", F.col("size").alias("ls"), F.col("sha1").alias("lh"), F.lit(True).alias("inl"))
    d = listing.select("path", F.col("size").alias("ds"), F.col("sha1").alias("dh"), F.lit(True).alias("ind"))
    same = (F.col("ls") == F.col("ds")) & (F.col("lh") == F.col("dh"))
    return l.join(d, "path", "full_outer").select("path", (
        F.when(F.col("inl").isNull(), "foreign").when(F.col("ind").isNull(), "dropped")
        .when(is_true(same), "clearable").otherwise("changed")
    ).alias("status"))


def catalog_diff(catalog: DataFrame, listing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(case_id, status): new, changed, restored, missing, still_missing or unchanged.

    catalog: case_id, size, mtime (seconds), parser_version, parsed, missing; listing: case_id, size, mtime.
    """
    c = catalog.select("case_id", F.col("size").alias("cs"), F.col("mtime").alias("cm"), "parser_version", "parsed", "missing", F.lit(True).alias("inc"))
    d = listing.select("case_id", F.col("size").alias("ds"), F.col("mtime").alias("dm"), F.lit(True).alias("ind"))
    stale = (
        ~F.col("cs").eqNullSafe(F.col("ds")) | ~is_true(F.abs(F.col("cm") - F.col("dm")) < 0.002)
        | ~F.col("parser_version").eqNullSafe(F.lit(settings.parser_version)) | ~is_true(F.col("parsed"))
    )
    gone = is_true(F.col("missing"))
    status = (
        F.when(F.col("inc").isNull(), "new")
        .when(F.col("ind").isNull(), F.when(gone, "still_missing").otherwise("missing"))
        .when(stale, "changed").when(gone, "restored").otherwise("unchanged")
    )
    return c.join(d, "case_id", "full_outer").select("case_id", status.alias("status"))


def inherit_renames(newcomers: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """The catalog after new files are met: a newcomer takes over what was done to a missing case of the same content, which goes.

    Both: case_id, filename, sha1, ord and V.INHERITED (overrides MAP, lifecycle flags with *_at, notes, history); the catalog has
    `missing`, newcomers `known_sha1`, the content stored before. Only a newcomer that was never read and not edited takes over; a
    field the giver has not (null) stays its own, and an audit line names the giver. One giver serves one newcomer: of equal contents
    the n-th giver by (ord, case_id) gives to the n-th newcomer. Returns case_id, filename, sha1, V.INHERITED, inherited_from.
    """
    def ranked(df: DataFrame) -> DataFrame:
        return row_numbers(df, ["sha1"], [F.col("ord"), F.col("case_id")], F.col("ord"), "__n")

    untouched = F.col("known_sha1").isNull() & (F.coalesce(F.size("overrides"), F.lit(0)) <= 0) & F.col("sha1").isNotNull()
    gives = is_true(F.col("missing")) & F.col("sha1").isNotNull()
    giver = ranked(catalog.where(gives)).select("sha1", "__n", F.struct("case_id", "filename", *V.INHERITED).alias("g"))
    met = ranked(newcomers.where(untouched)).join(giver, ["sha1", "__n"], "left")
    took = F.col("g").isNotNull()
    line = F.struct(now.cast("timestamp").alias("at"), F.concat(F.lit("Renamed from "), "g.filename").alias("what"))
    fields = {f: F.coalesce(F.col(f"g.{f}"), F.col(f)) for f in V.INHERITED}
    history = F.coalesce(fields["history"], F.array().cast("array<struct<at:timestamp,what:string>>"))
    fields["history"] = F.when(took, F.array_append(history, line)).otherwise(F.col("history"))
    inherited = met.select("case_id", "filename", "sha1", *[c.alias(f) for f, c in fields.items()], F.col("g.case_id").alias("inherited_from"))
    plain = ["case_id", "filename", "sha1", *V.INHERITED]
    rest = newcomers.where(~is_true(untouched)).select(plain).unionByName(
        catalog.join(inherited.where("inherited_from IS NOT NULL").select(F.col("inherited_from").alias("gone")), F.col("case_id") == F.col("gone"), "left_anti").select(plain)
    )
    return inherited.unionByName(rest.withColumn("inherited_from", F.lit(None).cast(dict(inherited.dtypes)["inherited_from"])))


def held_back(cases: DataFrame, under_review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to push, held): cases whose replacement is under review are held."""
    ids = under_review.select("case_id").distinct()
    return cases.join(ids, "case_id", "left_anti"), cases.join(ids, "case_id", "left_semi")


def transitions(prev: DataFrame, cur: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """(case_id, step) that went from open to done; cases not seen before only set a baseline."""
    steps = steps or V.STEPS
    was = prev.select("case_id", *[F.col(s).alias(f"p_{s}") for s in steps])
    passed = F.array_compact(F.array(*[
        F.when(is_false(F.col(f"p_{s}")) & is_true(F.col(s)), F.lit(s)) for s in steps
    ]))
    return cur.join(was, "case_id").select("case_id", F.explode(passed).alias("step"))


def verify_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, problem) of an archive listing against its manifest.

    manifest: path, size, checksum; entries: path, size, checksum.
    """
    parts = F.split(F.regexp_extract("path", r"^(?:dump|metadata)/(.+)$", 1), "/")
    lead = F.regexp_extract("path", r"^(dump|metadata)/(.+)$", 1)
    bad = (
        (lead == "") | F.contains("path", F.lit("\\")) | F.contains("path", F.lit(":")) | F.col("path").endswith("/")
        | F.exists(parts, lambda p: p.isin("", ".", ".."))
        | ((lead == "dump") & ((F.size(parts) != 1) | ~F.col("path").rlike(r"(?i)\.pdf$")))
    )
    special = F.col("path").isin("manifest.json", "config.json")
    bad_paths = entries.where(~special & bad).select("path", F.lit("unexpected path").alias("problem"))
    twice = entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("listed twice").alias("problem"))
    m = manifest.select("path", F.col("size").alias("ms"), F.col("checksum").alias("mc"))
    seen = entries.select("path", F.col("size").alias("es"), F.col("checksum").alias("ec"), F.lit(True).alias("here"))
    joined = m.join(seen, "path", "left")
    problem = F.when(F.col("here").isNull(), "missing").when(F.col("ms") != F.col("es"), "size differs").when(
        F.col("mc") != F.col("ec"), "checksum differs"
    )
    checked = joined.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
    return bad_paths.unionByName(twice).unionByName(checked).distinct()


# ---- table changes ------------------------------------------------------------------------------------

def apply_patch(catalog: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Apply edits: one patch row per case (case_id, set MAP, reset ARRAY, flags MAP<STRING,BOOLEAN>, notes).

    Only known fields are accepted; `reset` returns a field to what was detected; flags stamp their time; an
    audit entry lists the real changes and nothing is written when nothing changed.
    catalog: case_id, overrides MAP, the lifecycle flags with *_at, notes, history ARRAY<STRUCT<at,what>>.
    """
    allowed = F.array(*[F.lit(k) for k in [*V.RECORD_FIELDS, *V.STEPS]])
    p = patch.select("case_id", F.col("set").alias("__set"), F.col("reset").alias("__reset"), F.col("flags").alias("__flags"), F.col("notes").alias("__notes"))
    j = catalog.join(p, "case_id", "left")
    has = lambda m, k: F.map_contains_key(m, k)
    old = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    wanted = F.map_filter(
        F.coalesce("__set", F.create_map().cast("map<string,string>")),
        lambda k, v: F.array_contains(allowed, k) & v.isNotNull() & ~v.eqNullSafe(F.try_element_at(old, k)),
    )
    cleared = F.filter(
        F.coalesce("__reset", F.array().cast("array<string>")), lambda k: F.array_contains(allowed, k) & has(old, k)
    )
    j = j.withColumn("__w", wanted).withColumn("__c", cleared)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.col("__c"), k) & ~has(F.col("__w"), k))
    shown = lambda v: F.when(v == "true", "yes").when(v == "false", "no").otherwise(v)
    notes_changed = F.col("__notes").isNotNull() & ~F.col("__notes").eqNullSafe(F.col("notes"))
    flag = lambda f: F.try_element_at("__flags", F.lit(f))
    flips = {f: flag(f).isNotNull() & (flag(f) != is_true(F.col(f))) for f in LIFECYCLE}
    changes = F.concat(
        F.transform(F.col("__c"), lambda k: F.concat(k, F.lit(" reset to detected"))),
        F.transform(F.array_sort(F.map_entries("__w")), lambda e: F.concat(e["key"], F.lit(" → "), shown(e["value"]))),
        F.array_compact(F.array(*[
            F.when(is_true(flips[f]), F.when(flag(f), on).otherwise(off)) for f, (on, off) in LIFECYCLE.items()
        ])),
        F.when(is_true(notes_changed), F.array(F.lit("notes edited"))).otherwise(F.array().cast("array<string>")),
    )
    j = j.withColumn("__changes", changes)
    edited = F.size("__changes") > 0
    history = F.coalesce("history", F.array().cast("array<struct<at:timestamp,what:string>>"))
    entry = F.struct(now.cast("timestamp").alias("at"), F.array_join("__changes", "; ").alias("what"))
    out = {
        "overrides": F.map_concat(kept, F.col("__w")),
        "notes": F.coalesce("__notes", "notes"),
        "history": F.when(edited, trim_history(F.array_append(history, entry))).otherwise(history),
    }
    for f in LIFECYCLE:
        flipped = is_true(flips[f])
        out[f] = F.when(flipped, flag(f)).otherwise(F.col(f))
        out[f"{f}_at"] = F.when(flipped, F.when(flag(f), now.cast("timestamp"))).otherwise(F.col(f"{f}_at"))
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in catalog.columns], F.size("__changes").alias("changes"))


def bulk_patch(catalog: DataFrame, ids: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """The same patch for many cases; more than one patch row is an error, since each case would be doubled."""
    first = patch.limit(2).collect()
    if len(first) > 1:
        raise ValueError("a bulk patch is one row")
    one = F.broadcast(patch.sparkSession.createDataFrame(first, patch.schema).withColumn("__one", F.lit(1)))
    rows = ids.select("case_id").distinct().withColumn("__one", F.lit(1)).join(one, "__one").drop("__one")
    return apply_patch(catalog, rows, now)


def keep_earlier_read(prev: DataFrame, new: DataFrame) -> DataFrame:
    """A machine-readable case that comes back as a scan keeps its earlier read and returns to review.

    prev, new: case_id, sha1, mode, content, error; prev also reviewed.
    """
    p = prev.select("case_id", *[F.col(c).alias(f"p_{c}") for c in ("sha1", "mode", "content", "error", "reviewed")])
    j = new.join(p, "case_id", "left")
    back = is_true(
        F.col("p_sha1").isNotNull() & (F.col("p_sha1") != F.col("sha1")) & (F.coalesce("p_error", F.lit("")) == "")
        & (F.col("p_mode") != "raster") & (F.col("mode") == "raster")
    )
    return j.select(
        "case_id", "sha1", F.when(back, F.col("p_mode")).otherwise(F.col("mode")).alias("mode"),
        F.when(back, F.col("p_content")).otherwise(F.col("content")).alias("content"),
        F.when(back, False).otherwise(F.coalesce("p_reviewed", F.lit(False))).alias("reviewed"), back.alias("scanned_back"),
    )


def resolve_pulled(pending: DataFrame, decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Route of every decided item: replaced, review, added, ignored or error.

    pending: token, filename; decisions: token, action, case_id, review; catalog: case_id.
    """
    known = catalog.select(F.col("case_id").alias("__k")).distinct()
    j = pending.join(decisions, "token").join(known, F.col("case_id") == F.col("__k"), "left")
    route = (
        F.when(F.col("action") == "replace", F.when(F.col("__k").isNull(), "error")
               .when(is_true(F.col("review")), "review").otherwise("replaced"))
        .when(F.col("action") == "new", "added").when(F.col("action") == "ignore", "ignored").otherwise("error")
    )
    return j.select("token", "filename", "case_id", route.alias("route"))


def bulk_plan(records: DataFrame, step: str, settings: Settings = Settings()) -> DataFrame:
    """Cases waiting on a bulk step and the boxes that would be written (case_id, ready, items ARRAY<STRING>).

    records: case_id, lifecycle and step flags, parsed, slots MAP of struct(filled, located, page).
    """
    spec = V.BULK_STEPS[step]
    dates = spec["dates"] if not spec["date_setting"] or getattr(settings, spec["date_setting"]) else []
    at = lambda k: F.try_element_at("slots", F.lit(k))
    usable = lambda k: is_true(at(k)["located"]) & at(k)["page"].isNotNull()
    waiting = ~is_true(F.col("archived")) & ~is_true(F.col("rejected")) & ~is_true(F.col("missing")) & is_false(F.col(step))
    ready = is_true(F.col("parsed")) & usable(spec["initials"])
    items = F.array_compact(F.array(
        F.when(~is_true(at(spec["initials"])["filled"]), F.lit(spec["initials"])),
        *[F.when(usable(k) & ~is_true(at(k)["filled"]), F.lit(k)) for k in dates],
    ))
    return records.where(waiting).select(
        "case_id", ready.alias("ready"), F.when(ready, items).otherwise(F.array().cast("array<string>")).alias("items")
    )


def bulk_step(records: DataFrame, plan: DataFrame, step: str) -> DataFrame:
    """Mark the planned cases done, with the audit text (case_id, flag, what)."""
    ready = plan.where("ready").select("case_id", "items")
    initials = V.BULK_STEPS[step]["initials"]
    kinds = F.transform("items", lambda k: F.when(k == initials, "initials").otherwise("date"))
    what = F.when(F.size("items") > 0, F.concat(F.lit("wrote "), F.array_join(kinds, " and "))).otherwise("already filled in")
    j = records.join(ready, "case_id", "left")
    return j.select("case_id", F.when(F.col("items").isNotNull(), True).otherwise(F.col(step)).alias("flag"),
                    F.when(F.col("items").isNotNull(), what).alias("what"))


def collision_names(incoming: DataFrame, taken: DataFrame, block: int = 65536) -> DataFrame:
    """Free names for new files: "stem", "stem (2)", "stem (3)"... skipping the numbers in use.

    incoming: stem, ord (whole number); taken: stem, number (1 is the bare name). The k-th newcomer takes the
    k-th free number. A taken number t leaves t - i free ones up to it, i being its place among the taken ones.
    Both are running counts, kept per block, so one very common stem is still split over many tasks.
    """
    used = taken.select("stem", F.col("number").cast("bigint").alias("number")).distinct()
    used = row_numbers(used, ["stem"], [F.col("number")], F.floor(F.col("number") / block), "i")
    gaps = used.select("stem", (F.col("number") - F.col("i")).alias("at"), F.lit(0).alias("side"), F.lit(1).cast("bigint").alias("step"), F.lit(None).cast("bigint").alias("ord"))
    new = row_numbers(incoming.select("stem", "ord"), ["stem"], [F.col("ord")], F.floor(F.col("ord") / block), "k")
    want = new.select("stem", (F.col("k") - 1).alias("at"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("step"), F.col("ord").cast("bigint").alias("ord"))
    merged = running_total(
        gaps.unionByName(want), ["stem"], [F.col("at"), F.col("side"), F.col("ord")], F.floor(F.col("at") / block),
        F.col("step"), "skip",
    )
    number = F.col("at") + 1 + F.col("skip")
    name = F.when(number == 1, F.col("stem")).otherwise(F.concat(F.col("stem"), F.lit(" ("), number.cast("string"), F.lit(")")))
    return merged.where(F.col("side") == 1).select("stem", "ord", number.alias("number"), name.alias("filename"))


def stamp_changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Workbooks to read again: no stamp yet, or another size or time than last read."""
    s = state.select("path", F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    j = listing.join(s, "path", "left")
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("mtime").eqNullSafe(F.col("__m"))
    return j.where(~same).drop("__s", "__m")

