"""Snapshots, folders, ledgers and table changes over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import reconcile as X
from ..operators import reports as R
from ..operators.scale import keep_first
from ..session import cut_lineage
from ..sources import io
from .bindings import cases, table, with_cases
from .record_queries import form_cases
from .registry import query


@query("folder_listing", "S1", why_no_sql="reads file metadata")
def folder_listing(spark, sf):
    return io.list_folder(spark, sf, "*.parquet", exclude=["region.parquet"]).select("filename", "size")


# ---- files: an order is a file; its price is its size, its row the content ------------------------------

_FILE = ["concat('in/', o_orderkey, '.pdf') AS path", "cast(o_totalprice * 100 AS bigint) AS size",
         "o_orderdate AS mtime", "sha1(concat_ws('|', o_orderkey, o_orderpriority)) AS sha1", "o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"]
_FILE_SQL = """f AS (SELECT 'in/' || o_orderkey || '.pdf' AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS mtime,
  sha1(o_orderkey || '|' || o_orderpriority) AS sha1, o_orderstatus, o_orderpriority, o_orderkey, o_custkey FROM orders)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_FILE).withColumn("size", F.expr("size"))


@query("incremental_pull", "S3", f"""WITH {_FILE_SQL}
SELECT path FROM f WHERE mtime > TIMESTAMP '1998-01-01' AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
  AND NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AND NOT (o_orderstatus = 'F' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM'))""")
def incremental_pull(spark, sf):
    f = files(spark, sf).withColumn("added", F.col("mtime"))
    keyed = f.withColumn("file_key", F.concat_ws("|", F.lower("path"), "size", F.unix_millis(F.col("mtime").cast("timestamp"))))
    handled = keyed.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select("file_key")
    pending = keyed.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select("file_key")
    ledger = f.where("o_orderstatus = 'F'").selectExpr("upper(path) AS path", "if(o_orderpriority = '1-URGENT', size + 1, size) AS size",
                                                        "if(o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW'), 'other', sha1) AS sha1")
    return X.incremental_pull(f, F.lit("1998-01-01").cast("timestamp_ntz"), handled, pending, ledger).select("path")


@query("ledger_status", "J8", f"""WITH {_FILE_SQL}
SELECT path, CASE WHEN o_orderstatus = 'O' THEN 'foreign' WHEN o_orderstatus = 'P' THEN 'dropped'
  WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'changed' ELSE 'clearable' END AS status FROM f""")
def ledger_status(spark, sf):
    f = files(spark, sf)
    ledger = f.where("o_orderstatus <> 'O'").selectExpr("path", "if(o_orderpriority = '1-URGENT', size + 1, size) AS size", "if(o_orderpriority = '5-LOW', 'x', sha1) AS sha1")
    return X.ledger_status(ledger, f.where("o_orderstatus <> 'P'"))


@query("catalog_diff", "J9", """
SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-01-01' THEN 'new'
  WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'still_missing' ELSE 'missing' END
  WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'changed' WHEN o_orderpriority = '5-LOW' THEN 'restored' ELSE 'unchanged' END AS status FROM orders""")
def catalog_diff(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS case_id", "cast(o_totalprice * 100 AS bigint) AS size", "o_orderpriority AS p",
                                              "cast(unix_timestamp(cast(o_orderdate AS timestamp)) AS double) AS mtime", "o_orderdate", "o_orderstatus")
    catalog = o.where("NOT (o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00')").selectExpr(
        "case_id", "if(p = '1-URGENT', size + 1, size) AS size", "if(p = '2-HIGH', mtime + 1, mtime + 0.001) AS mtime", "if(p = '3-MEDIUM', 19, 20) AS parser_version",
        "true AS parsed", "p = '5-LOW' AS missing")
    return X.catalog_diff(catalog, o.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"))


@query("rename_inheritance", "J10", """
WITH o AS (SELECT o_orderkey AS case_id, o_orderkey || '.pdf' AS filename, sha1(o_custkey || o_orderpriority) AS h, o_orderstatus AS st, o_orderdate AS d, o_custkey AS k, o_orderpriority AS p, o_totalprice AS t FROM orders),
cat AS (SELECT *, st = 'P' AS missing, CASE WHEN t > 150000 THEN 'name=n' || k END AS overrides, t > 200000 AS reviewed, k % 2 = 0 AS logged, k % 3 = 0 AS archived, k % 5 = 0 AS rejected,
  CASE WHEN k % 4 > 0 THEN 'note ' || case_id END AS notes, 1 AS n_history FROM o WHERE st <> 'O'),
new AS (SELECT *, CASE WHEN p = '5-LOW' THEN 'name=own' END AS overrides, k % 7 <> 0 AND p <> '5-LOW' AS fresh FROM o WHERE st = 'O'),
giver AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY d, case_id) AS n FROM cat WHERE missing),
taker AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY d, case_id) AS n FROM new WHERE fresh),
met AS (SELECT a.case_id, a.filename, CASE WHEN g.case_id IS NULL THEN '' ELSE coalesce(g.overrides, '') END AS overrides, coalesce(g.reviewed, false) AS reviewed,
    CASE WHEN g.reviewed THEN g.d END AS reviewed_at, coalesce(g.logged, false) AS logged, coalesce(g.archived, false) AS archived, coalesce(g.rejected, false) AS rejected,
    coalesce(g.notes, 'own note') AS notes, CASE WHEN g.case_id IS NULL THEN 0 ELSE g.n_history + 1 END AS n_history, 'Renamed from ' || g.filename AS last_line, g.case_id AS inherited_from
  FROM taker a LEFT JOIN giver g ON g.h = a.h AND g.n = a.n)
SELECT * FROM met
UNION ALL SELECT case_id, filename, coalesce(overrides, ''), false, NULL, false, false, false, 'own note', 0, NULL, NULL FROM new WHERE NOT fresh
UNION ALL SELECT case_id, filename, coalesce(overrides, ''), reviewed, CASE WHEN reviewed THEN d END, logged, archived, rejected, notes, n_history, 'read', NULL
  FROM cat WHERE case_id NOT IN (SELECT inherited_from FROM met WHERE inherited_from IS NOT NULL)""")
def rename_inheritance(spark, sf):
    none = "cast(map() AS map<string, string>)"
    log = "array<struct<at: timestamp, what: string>>"
    flags = {"reviewed": "o_totalprice > 200000", "logged": "o_custkey % 2 = 0", "archived": "o_custkey % 3 = 0", "rejected": "o_custkey % 5 = 0"}
    o = table(spark, sf, "orders").withColumn("when", F.col("o_orderdate").cast("timestamp")).selectExpr(
        "*", "o_orderkey AS case_id", "concat(o_orderkey, '.pdf') AS filename", "sha1(concat(o_custkey, o_orderpriority)) AS sha1", "o_orderdate AS ord")
    catalog = o.where("o_orderstatus <> 'O'").selectExpr(
        "case_id", "filename", "sha1", "ord", "o_orderstatus = 'P' AS missing", f"if(o_totalprice > 150000, map('name', concat('n', o_custkey)), {none}) AS overrides",
        *[f"{c} AS {f}" for f, c in flags.items()], *[f"if({c}, when, null) AS {f}_at" for f, c in flags.items()],
        "if(o_custkey % 4 > 0, concat('note ', o_orderkey), null) AS notes", f"cast(array(struct(when, 'read')) AS {log}) AS history")
    new = o.where("o_orderstatus = 'O'").selectExpr(
        "case_id", "filename", "sha1", "ord", "if(o_custkey % 7 = 0, 'x', null) AS known_sha1", f"if(o_orderpriority = '5-LOW', map('name', 'own'), {none}) AS overrides",
        *[f"false AS {f}" for f in flags], *[f"cast(null AS timestamp) AS {f}_at" for f in flags], "'own note' AS notes", f"cast(array() AS {log}) AS history")
    out = X.inherit_renames(new, catalog, F.lit("2026-01-01 00:00:00"))
    pairs = F.transform(F.map_entries("overrides"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "case_id", "filename", F.concat_ws(",", pairs).alias("overrides"), "reviewed", F.col("reviewed_at").cast("timestamp_ntz").alias("reviewed_at"), "logged", "archived", "rejected", "notes",
        F.size("history").alias("n_history"), F.try_element_at("history", F.lit(-1))["what"].alias("last_line"), "inherited_from")


@query("held_back", "J11", with_cases("""
SELECT case_id, reviewed AND pos_neg = '' AS held FROM cases WHERE is_parsed"""))
def held_back(spark, sf):
    c = cases(spark, sf).where(R.parsed())
    go, held = X.held_back(c.select("case_id"), c.where("reviewed AND pos_neg = ''").select("case_id"))
    return go.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


def _before(spark, sf):
    """The same cases some time earlier: pending ones had no signatures, the newest did not exist."""
    c = cases(spark, sf).where("NOT missing AND NOT archived AND parsed AND NOT rejected")
    back = {s: f"if(o_orderstatus = 'F' AND n_a > 0 AND {s} IS NOT NULL, false, {s}) AS {s}" for s in V.STEPS}
    return c, c.where("o_orderdate < TIMESTAMP_NTZ '2000-06-01 00:00:00'").selectExpr("case_id", *back.values())


@query("step_transitions", "J12", with_cases(" UNION ALL ".join(
    f"SELECT case_id, '{s}' AS step FROM cases WHERE is_parsed AND o_orderdate < TIMESTAMP '2000-06-01' AND o_orderstatus = 'F' AND n_a > 0 AND {s}" for s in V.STEPS)))
def step_transitions(spark, sf):
    cur, prev = _before(spark, sf)
    return X.transitions(prev, cur.select("case_id", *V.STEPS))


@query("manifest_check", "J15", why_no_sql="checks file contents against a manifest")
def manifest_check(spark, sf):
    """The table files against a manifest that disagrees about some of them, and an escaping path."""
    real = cut_lineage(io.file_digests(spark, sf, "*.parquet"), "digests")
    inside = real.withColumn("path", F.concat(F.lit("metadata/"), "path"))
    manifest = inside.selectExpr("path", "if(path LIKE '%nation%', size + 1, size) AS size", "if(path LIKE '%region%', 'x', checksum) AS checksum")
    manifest = manifest.unionByName(inside.where("path LIKE '%part.parquet'").withColumn("path", F.lit("metadata/gone.json")))
    extra = inside.where("path LIKE '%events%'")
    entries = inside.unionByName(extra).unionByName(extra.withColumn("path", F.lit("metadata/../up")))
    return X.verify_manifest(manifest, entries)


# ---- table changes ---------------------------------------------------------------------------------------

def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).selectExpr(
        "case_id", "o_orderpriority", "o_orderstatus", "n_a", "map_filter(map('issuer', if(n_a > 2, 'Old Name', NULL), 'squadron', if(n_a > 1, 'SQ1', NULL)), (k, v) -> v IS NOT NULL) AS overrides",
        "reviewed", "cast(NULL AS timestamp) AS reviewed_at", "logged", "cast(NULL AS timestamp) AS logged_at", "archived", "cast(NULL AS timestamp) AS archived_at",
        "rejected", "cast(NULL AS timestamp) AS rejected_at", "notes",
        "transform(sequence(1, if(n_lines > 6, 60, 2)), i -> struct(TIMESTAMP '2024-01-01 00:00:00' AS at, concat('entry ', i) AS what)) AS history")


_NOW = "2026-01-02 03:04:05"


@query("patched_catalog", "M1", with_cases(f"""
, p AS (SELECT *, o_orderstatus = 'P' AS hit FROM cases)
SELECT case_id, CASE WHEN hit THEN 'New Name' WHEN n_a > 2 THEN 'Old Name' END AS issuer, CASE WHEN hit AND o_orderpriority = '1-URGENT' THEN NULL WHEN n_a > 1 THEN 'SQ1' END AS squadron,
  CASE WHEN hit THEN true ELSE reviewed END AS reviewed, CASE WHEN hit AND NOT reviewed THEN TIMESTAMP '{_NOW}' END AS reviewed_at,
  CASE WHEN hit THEN false ELSE logged END AS logged, CASE WHEN hit AND o_orderpriority = '2-HIGH' THEN 'checked' ELSE notes END AS notes,
  CASE WHEN hit THEN least((CASE WHEN n_lines > 6 THEN 60 ELSE 2 END) + 1, 60) WHEN n_lines > 6 THEN 60 ELSE 2 END AS entries,
  CASE WHEN hit THEN concat_ws('; ', CASE WHEN o_orderpriority = '1-URGENT' AND n_a > 1 THEN 'squadron reset to detected' END, 'issuer → New Name',
    CASE WHEN NOT reviewed THEN 'marked reviewed' END, CASE WHEN logged THEN 'unmarked logged to sheet' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'notes edited' END)
    ELSE 'entry ' || CASE WHEN n_lines > 6 THEN 60 ELSE 2 END END AS last FROM p""").replace("\n\n,", "\n,"))
def patched_catalog(spark, sf):
    c = catalog(spark, sf)
    patch = c.where("o_orderstatus = 'P'").selectExpr(
        "case_id", "map('issuer', 'New Name', 'colour', 'red') AS set", "if(o_orderpriority = '1-URGENT', array('squadron', 'tours'), array()) AS reset",
        "map('reviewed', true, 'logged', false) AS flags", "if(o_orderpriority = '2-HIGH', 'checked', NULL) AS notes")
    return _shown(X.apply_patch(c, patch, F.lit(_NOW)))


def _shown(out: DataFrame) -> DataFrame:
    return out.selectExpr("case_id", "overrides['issuer'] AS issuer", "overrides['squadron'] AS squadron", "reviewed", "reviewed_at", "logged", "notes",
                          "size(history) AS entries", "element_at(history, -1).what AS last")


@query("bulk_patched_catalog", "M2", with_cases(f"""
SELECT case_id, reviewed OR is_active AS reviewed, CASE WHEN is_active AND NOT reviewed THEN TIMESTAMP '{_NOW}' END AS reviewed_at,
  CASE WHEN is_active AND NOT reviewed THEN 'marked reviewed' ELSE 'entry ' || CASE WHEN n_lines > 6 THEN 60 ELSE 2 END END AS last FROM cases"""))
def bulk_patched_catalog(spark, sf):
    ids = cases(spark, sf).where(R.active()).select("case_id")
    patch = spark.range(1).selectExpr("cast(map() AS map<string,string>) AS set", "cast(array() AS array<string>) AS reset", "map('reviewed', true) AS flags", "cast(NULL AS string) AS notes")
    return _shown(X.bulk_patch(catalog(spark, sf), ids, patch, F.lit(_NOW))).select("case_id", "reviewed", "reviewed_at", "last")


@query("earlier_reads_kept", "M3", with_cases("""
SELECT case_id, CASE WHEN n_a = 0 AND n_lines < 5 AND n_lines > 1 THEN 'fields' WHEN n_a = 0 THEN 'raster' ELSE 'fields' END AS mode,
  CASE WHEN n_a = 0 AND n_lines < 5 AND n_lines > 1 THEN 'old' ELSE 'new' END AS content,
  CASE WHEN n_a = 0 AND n_lines < 5 AND n_lines > 1 THEN false ELSE n_r > 1 END AS reviewed, n_a = 0 AND n_lines < 5 AND n_lines > 1 AS scanned_back FROM cases"""))
def earlier_reads_kept(spark, sf):
    c = cases(spark, sf)
    prev = c.selectExpr("case_id", "'a' AS sha1", "if(n_lines < 5, 'fields', 'raster') AS mode", "'old' AS content", "'' AS error", "n_r > 1 AS reviewed")
    new = c.selectExpr("case_id", "if(n_lines > 1, 'b', 'a') AS sha1", "if(n_a = 0, 'raster', 'fields') AS mode", "'new' AS content", "'' AS error")
    return X.keep_earlier_read(prev, new).select("case_id", "mode", "content", "reviewed", "scanned_back")


@query("pulled_items_resolved", "M6", """
SELECT o_orderkey AS token, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'error'
    WHEN o_orderpriority = '2-HIGH' THEN 'review' ELSE 'replaced' END WHEN o_orderpriority = '3-MEDIUM' THEN 'added' WHEN o_orderpriority = '5-LOW' THEN 'ignored' ELSE 'error' END AS route
FROM orders WHERE o_orderstatus <> 'F'""")
def pulled_items_resolved(spark, sf):
    o = table(spark, sf, "orders")
    pending = o.selectExpr("o_orderkey AS token", "concat(o_orderkey, '.pdf') AS filename")
    decisions = o.where("o_orderstatus <> 'F'").selectExpr(
        "o_orderkey AS token", "o_custkey AS case_id", "o_orderpriority = '2-HIGH' AS review",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'replace' WHEN '2-HIGH' THEN 'replace' WHEN '3-MEDIUM' THEN 'new' WHEN '5-LOW' THEN 'ignore' ELSE 'what' END AS action")
    known = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    return X.resolve_pulled(pending, decisions, known).select("token", "route")


_WAITING = "NOT archived AND NOT rejected AND NOT missing AND cadet_cc_initialed = false"


@query("bulk_step_plan", "P16", with_cases(f"""
SELECT case_id, parsed AND n_lines <> 3 AS ready, CASE WHEN parsed AND n_lines <> 3 THEN 'cadet_sqcc_initials,cadet_sqcc_date' ELSE '' END AS items FROM cases WHERE {_WAITING}"""))
def bulk_step_plan(spark, sf):
    return X.bulk_plan(form_cases(spark, sf), "cadet_cc_initialed").select("case_id", "ready", F.array_join("items", ",").alias("items"))


@query("bulk_step_done", "M7", with_cases(f"""
SELECT case_id, CASE WHEN {_WAITING} AND parsed AND n_lines <> 3 THEN true ELSE cadet_cc_initialed END AS flag,
  CASE WHEN {_WAITING} AND parsed AND n_lines <> 3 THEN 'wrote initials and date' END AS what FROM cases"""))
def bulk_step_done(spark, sf):
    c = form_cases(spark, sf)
    return X.bulk_step(c, X.bulk_plan(c, "cadet_cc_initialed"), "cadet_cc_initialed")


@query("collision_names", "W7", """
WITH t AS (SELECT o_orderpriority AS stem, o_custkey + 1 AS number FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY number) AS i FROM t),
n AS (SELECT o_orderpriority AS stem, o_orderkey AS ord, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT n.stem, n.ord, n.k + (SELECT count(*) FROM u WHERE u.stem = n.stem AND u.number - u.i <= n.k - 1) AS number FROM n)
SELECT stem, ord, number, CASE WHEN number = 1 THEN stem ELSE stem || ' (' || number || ')' END AS filename FROM r""")
def collision_names(spark, sf):
    o = table(spark, sf, "orders")
    taken = o.where("o_orderstatus = 'F'").selectExpr("o_orderpriority AS stem", "o_custkey + 1 AS number")
    new = o.where("o_orderstatus = 'O'").selectExpr("o_orderpriority AS stem", "o_orderkey AS ord")
    return X.collision_names(new, taken, block=256)


@query("snapshot_retention", "S11", """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""")
def snapshot_retention(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return keep_first(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], V.BACKUPS_KEEP).select("user_id", "event_id")


@query("history_trimmed", "W5", with_cases("""
SELECT case_id, least(60, CASE WHEN n_lines > 4 THEN 50 + 10 * n_lines ELSE n_lines END) AS entries,
  CASE WHEN n_lines > 4 THEN 50 + 10 * n_lines - 59 ELSE least(n_lines, 1) END AS first FROM cases"""))
def history_trimmed(spark, sf):
    h = cases(spark, sf).selectExpr("case_id", "if(n_lines > 4, 50 + 10 * n_lines, n_lines) AS n")
    h = h.selectExpr("case_id", "if(n > 0, transform(sequence(1, cast(n AS int)), i -> struct(i AS at)), cast(array() AS array<struct<at:int>>)) AS history")
    t = h.select("case_id", R.trim_history(F.col("history")).alias("h"))
    return t.select("case_id", F.size("h").alias("entries"), F.coalesce(F.get("h", F.lit(0))["at"], F.lit(0)).alias("first"))


@query("changed_workbooks", "T6", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def changed_workbooks(spark, sf):
    o = table(spark, sf, "orders").selectExpr("concat('book-', o_orderkey) AS path", "cast(o_totalprice AS bigint) AS size", "o_orderdate AS mtime", "o_orderpriority AS p", "o_orderstatus AS s", "o_orderkey")
    state = o.where("s <> 'P'").selectExpr("path", "if(p = '1-URGENT', size + 1, size) AS size", "if(p = '2-HIGH', mtime + interval 1 second, mtime) AS mtime")
    return X.stamp_changed(o, state).select("o_orderkey")


@query("case_catalog_json", "S6", with_cases("SELECT CAST(case_id AS VARCHAR) AS case_id, filename, form_type, reviewed, archived, CASE WHEN n_a > 2 THEN 'Old Name' END AS issuer FROM cases"))
def case_catalog_json(spark, sf):
    """One JSON record per case, written and read back with the declared schema."""
    from ..session import scratch_path

    c = cases(spark, sf).selectExpr("cast(case_id AS string) AS case_id", "filename", "form_type", "reviewed", "archived", "if(n_a > 2, map('issuer', 'Old Name'), cast(map() AS map<string,string>)) AS overrides")
    out = scratch_path(spark, "cases")
    c.write.json(out)
    return io.read_cases(spark, out).selectExpr("case_id", "filename", "form_type", "reviewed", "archived", "overrides['issuer'] AS issuer")


@query("delimited_roundtrip", "S4", """
SELECT p_partkey, p_name || ', "' || p_brand || '"' AS quoted, p_type FROM part""")
def delimited_roundtrip(spark, sf):
    """Part rows written with quoted cells holding delimiters and quotes, read back as rows of cells."""
    from ..session import scratch_path

    out = scratch_path(spark, "csv")
    p = table(spark, sf, "part").selectExpr("cast(p_partkey AS string) AS a", "concat(p_name, ', \"', p_brand, '\"') AS b", "p_type AS c")
    p.write.option("escape", '"').csv(out)
    rows = io.read_delimited(spark, out)
    return rows.selectExpr("cast(cells[0] AS bigint) AS p_partkey", "cells[1] AS quoted", "cells[2] AS p_type")
