"""Records from forms: derivation, flags, evidence, issues, roster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import parse_filename
from ..operators import records as RC
from ..operators.scale import spread
from ..session import cut_lineage
from .bindings import case_facts, cases, person_sql, person_text, table, with_cases
from .registry import query

_DATE = """CASE WHEN date_iso IS NULL THEN 'N/A' WHEN o_orderpriority = '1-URGENT' THEN date_format(add_months(date_iso, 72), 'd MMM yy')
  WHEN o_orderpriority = '2-HIGH' THEN date_format(add_months(date_iso, 72), 'MM/dd/yyyy') WHEN o_orderpriority = '3-MEDIUM' THEN date_format(add_months(date_iso, 72), 'yyyy-MM-dd')
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN date_format(add_months(date_iso, 72), 'MMMM d, yyyy') ELSE upper(date_format(add_months(date_iso, 72), 'ddMMMyyyy')) END"""


def _entry(key: str, value: str, ftype: str = "Text", filled: str | None = None, page: str = "1", located: str = "true") -> str:
    return (f"'{key}', named_struct('value_text', {value}, 'ftype', '{ftype}', 'filled', {filled or f'({value}) <> {chr(39) * 2}'}, "
            f"'source', if(n_lines > 7, 'ink', 'field'), 'located', {located}, 'within_tolerance', n_r > 0, 'source_widget', n_lines < 6, 'page', {page})")


_SLOTS = "map(" + ", ".join([
    _entry("recipient_name", "concat('C3C ', split(recipients, ' ')[1], ', ', split(recipients, ' ')[0])"),
    _entry("date", f"if(n_r > 0, {_DATE}, '')"),
    _entry("date_awarded", f"if(n_r = 0 AND form_type = 'F10', {_DATE}, '')"),
    _entry("counselee_date", f"if(n_r = 0 AND form_type = 'F174', {_DATE}, '')"),
    _entry("class_year", "if(class_year = '', '', concat('Class of ', class_year))"),
    _entry("squadron", "concat(' ', squadron, ' ')"),
    _entry("issuer", "concat(split(issuer, ' ')[1], ', ', split(issuer, ' ')[0])"),
    _entry("issuer_grade", "if(n_a > 0, 'C/Capt', '')"),
    _entry("narrative", "reason_details", located="n_lines <> 1"),
    _entry("reason", "if(n_r > 0, concat('returned ', n_r), '')"),
    _entry("demerits", "concat('1. DEMERIT(S) ', n_a)"), _entry("tours", "concat(n_r, ' tours')"),
    _entry("confinements", "if(n_lines = n_r + n_a, 'N/A', concat(n_lines - n_r - n_a, '.0'))"),
    _entry("loss_of_pass", "'none'"), _entry("pov_priv", "if(n_lines > 6, '5. REVOKE POV 1 week', '')"),
    _entry("sig_awarding", "''", "Signature", "issuer_signed"), _entry("sig_counselor", "''", "Signature", "issuer_signed"),
    _entry("sqccf_initials", "if(coalesce(sqccf_processed, false), 'AB', '')"), _entry("login_date", "''"),
    _entry("cadet_sqcc_initials", "if(coalesce(cadet_cc_initialed, false), 'CD', 'False')", "Text", "coalesce(cadet_cc_initialed, false)", "if(n_lines = 3, NULL, 2)"),
    _entry("cadet_sqcc_date", "''"),
    _entry("sig_recipient", "''", "Signature", "recipient_signed"), _entry("sig_aoc", "''", "Signature", "aoc_signed"),
    _entry("sig_commander", "''", "Signature", "aoc_signed"),
]) + ") AS slots"

_FORM = [
    "*", _SLOTS, "CASE WHEN n_lines > 7 THEN 'raster' WHEN n_lines = 5 THEN 'text' ELSE 'fields' END AS mode",
    f"""map_filter(map('pos_neg', if(o_orderpriority = '1-URGENT' AND o_totalprice > 300000, 'Pos', NULL),
      'recipients', if(n_lines = 2, concat(split(recipients, ' ')[1], ', ', split(recipients, ' ')[0], ', ', {person_text('(party_id + 2)')}), NULL),
      'aoc_signed', if(o_orderstatus = 'P' AND n_a > 2, 'true', NULL)), (k, v) -> v IS NOT NULL) AS overrides""",
    "if(n_lines = 4, map('squadron', 'typed'), cast(map() AS map<string,string>)) AS field_overrides",
    "if(parsed, '', 'unreadable') AS error", "n_a = 4 AS scan_replaced", "if(o_totalprice > 450000, 'looks like another form', '') AS type_note",
    "6 AS template_pages", "array(0, if(n_r = 0, -1, 1)) AS page_map", "array(n_f * 0.2D, 0.9D) AS layout_scores", "n_a AS extra_widgets",
]


def form_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases as forms that were read: a map of slots, typed corrections and a file name, kept as a catalog table."""
    c = spread(case_facts(spark, sf), "case_id").selectExpr(*_FORM).withColumn("fn", parse_filename("filename"))
    return cut_lineage(c.selectExpr("*", "fn.pos_neg AS file_pos_neg", "fn.reason AS file_reason").drop("fn"), "catalog")


_FORM_SQL = f"""
forms AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'Pos' ELSE pos_neg END AS pn2,
    CASE WHEN o_orderstatus = 'P' AND n_a > 2 THEN true ELSE aoc_signed END AS aoc2,
    split_part(recipients, ' ', 2) || ', ' || split_part(recipients, ' ', 1) || ', ' || {person_sql('(party_id + 2)')} AS typed
  FROM cases),
derived AS (SELECT *, (issuer_signed AND coalesce(sqccf_processed, true) AND coalesce(cadet_cc_initialed, true) AND recipient_signed AND aoc2) AS complete2 FROM forms)
"""

_DERIVED = """
SELECT case_id, CASE WHEN n_lines = 2 THEN typed ELSE recipients END AS recipients, form_type, pn2 AS pos_neg,
  coalesce(CAST(CAST(date_iso + INTERVAL 6 YEAR AS DATE) AS VARCHAR), 'N/A') AS date, CAST(date_iso + INTERVAL 6 YEAR AS DATE) AS date_iso, class_year, CASE WHEN n_lines = 4 THEN 'typed' ELSE squadron END AS squadron,
  trim(replace(reason_category, ' ', '') || ' ' || case_id) AS reason_category,
  CASE WHEN form_type = 'F174' AND n_r > 0 THEN 'returned ' || n_r ELSE reason_details END AS reason_details,
  CASE WHEN form_type = 'F174' THEN split_part(issuer, ' ', 2) || ', ' || split_part(issuer, ' ', 1) WHEN n_a > 0 THEN 'C/Capt ' || issuer ELSE issuer END AS issuer,
  CASE WHEN form_type = 'F10' THEN CAST(n_a AS VARCHAR) ELSE '' END AS demerits, CASE WHEN form_type = 'F10' THEN CAST(n_r AS VARCHAR) ELSE '' END AS tours,
  CASE WHEN form_type = 'F10' THEN CAST(n_lines - n_r - n_a AS VARCHAR) ELSE '' END AS confinements,
  CASE WHEN form_type = 'F10' AND n_lines > 6 THEN 'POV revoked: 1 week' ELSE '' END AS other,
  issuer_signed, sqccf_processed, cadet_cc_initialed, recipient_signed, aoc2 AS aoc_signed, complete2 AS complete,
  complete2 AND NOT rejected AND NOT archived AS counted,
  CASE WHEN n_lines = 2 THEN recipients || '|' || split_part(typed, ', ', 3) ELSE recipients END AS recipient_list,
  concat_ws(',', CASE WHEN o_orderstatus = 'P' AND n_a > 2 THEN 'aoc_signed' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'pos_neg' END,
    CASE WHEN n_lines = 2 THEN 'recipients' END) AS overridden
FROM derived"""


@query("record_derivation", "P1, P2, P3, P4", with_cases(_DERIVED, extra=_FORM_SQL))
def record_derivation(spark, sf):
    d = RC.derive(form_cases(spark, sf))
    return d.select(
        "case_id", "recipients", "form_type", "pos_neg", "date", "date_iso", "class_year", "squadron", "reason_category", "reason_details",
        "issuer", "demerits", "tours", "confinements", "other", *V.STEPS, "complete", "counted",
        F.array_join("recipient_list", "|").alias("recipient_list"), F.array_join("overridden", ",").alias("overridden"))


@query("step_flags", "P3", with_cases("SELECT case_id, " + ", ".join(V.STEPS) + " FROM cases"))
def step_flags(spark, sf):
    from ..config import Settings

    c = form_cases(spark, sf)
    return c.select("case_id", *[RC.step_flag(s, F.col("form_type"), Settings()).alias(s) for s in V.STEPS])


@query("effective_fields", "P1", with_cases(
    "SELECT case_id, CASE WHEN n_lines = 4 THEN 'typed' ELSE ' ' || squadron || ' ' END AS squadron, reason_details AS narrative FROM cases"))
def effective_fields(spark, sf):
    return RC.effective_fields(form_cases(spark, sf), ["squadron", "narrative"])


@query("completeness", "P4", with_cases("SELECT case_id, complete, counted FROM cases"))
def completeness(spark, sf):
    return cases(spark, sf).select("case_id", "complete", "counted")


@query("missing_manual", "P7", with_cases("""
SELECT case_id, CASE WHEN form_type = 'F10' AND pos_neg = 'Pos' THEN concat_ws(',', CASE WHEN cdna = '' THEN 'CDNA' END, CASE WHEN passes = '' THEN 'Passes' END) ELSE '' END AS missing FROM cases"""))
def missing_manual(spark, sf):
    m = RC.missing_manual(F.col("form_type"), F.col("pos_neg"), {"cdna": F.col("cdna"), "passes": F.col("passes")})
    return cases(spark, sf).select("case_id", F.array_join(m, ",").alias("missing"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as boxes with something in a field, in flattened text or as ink."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS case_id", "l_linenumber AS slot_no", "l_partkey AS ref", "l_suppkey AS ref2",
        "CASE l_returnflag WHEN 'R' THEN 'Signature' WHEN 'A' THEN 'CheckBox' ELSE 'Text' END AS ftype",
        "if(l_discount > 0.07, 'typed', '') AS field_value", "CASE WHEN l_tax > 0.06 THEN 'SIGN here' WHEN l_tax > 0.04 THEN 'sign' ELSE '' END AS flat",
        "l_tax * 4 AS ink", "cast(l_quantity AS int) AS ink_px", "l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 AS digital",
        "l_discount < 0.01 AS has_annot", "l_linestatus = 'F' AS source_widget",
    )


_EVIDENCE = """
e AS (SELECT l_orderkey AS case_id, l_linenumber AS slot_no, l_partkey AS ref, l_suppkey AS ref2, l_returnflag AS t, l_linestatus = 'F' AS source_widget,
  l_discount > 0.07 AS fld, CASE WHEN l_tax > 0.06 THEN CASE WHEN l_returnflag = 'R' THEN 'here' ELSE 'SIGN here' END WHEN l_tax > 0.04 AND l_returnflag <> 'R' THEN 'sign' ELSE '' END AS flat,
  CASE WHEN l_returnflag = 'A' THEN l_tax * 4 > 0.12 AND l_quantity >= 10 ELSE l_tax * 4 > 0.004 AND l_quantity >= 30 END AS ink,
  l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 AS digital, l_discount < 0.01 AS annot FROM lineitem),
v AS (SELECT *, CASE WHEN fld THEN 'typed' WHEN flat <> '' THEN CASE WHEN t = 'A' THEN 'true' ELSE flat END WHEN t = 'A' AND ink THEN 'true' ELSE '' END AS value,
  CASE WHEN fld THEN 'field' WHEN flat <> '' THEN 'text' WHEN t = 'A' AND ink THEN 'ink' END AS base FROM e),
r AS (SELECT *, value <> '' OR digital OR annot OR (t IN ('R', 'N') AND ink) AS filled,
  CASE WHEN t = 'R' AND digital THEN 'digital' WHEN t = 'R' AND annot THEN coalesce(base, 'annotation') WHEN t = 'R' AND ink THEN coalesce(base, 'ink')
    WHEN t = 'N' AND value = '' AND ink THEN 'ink' ELSE base END AS src FROM v)
"""


@query("slot_evidence", "P17", f"WITH {_EVIDENCE} SELECT case_id, slot_no, ref, ref2, value, filled, CASE WHEN filled THEN src END AS slot_source FROM r")
def slot_evidence(spark, sf):
    return RC.slot_result(evidence(spark, sf)).select("case_id", "slot_no", "ref", "ref2", "value", "filled", "slot_source")


@query("read_mode", "P18", f"""WITH {_EVIDENCE}
SELECT case_id, CASE WHEN count(*) FILTER (WHERE source_widget) >= 0.5 * count(*) THEN 'fields'
  WHEN bool_or(coalesce(src = 'text' AND value <> '' AND filled, false)) THEN 'text' ELSE 'raster' END AS mode FROM r GROUP BY 1""")
def read_mode(spark, sf):
    return RC.read_mode(RC.slot_result(evidence(spark, sf)).selectExpr("case_id", "source_widget", "slot_source AS source", "value"))


_N_WIDGET = "CASE WHEN n_lines < 6 THEN 24 ELSE 0 END"
_RULES = [
    ("scan_replaced", "review", "n_a = 4", "''"), ("no_pos_neg", "review", "pos_neg = ''", "''"),
    ("type_note", "review", "o_totalprice > 450000", "'looks like another form'"), ("extra_pages", "review", "n_lines > 6", "CAST(n_lines AS VARCHAR)"),
    ("page_missing", "review", "n_r = 0 AND n_lines = 3", "''"), ("few_fields", "review", "n_lines IN (6, 7)", "'0'"),
    ("flattened", "review", "n_lines = 5", "''"), ("scanned", "review", "n_lines > 7", "''"),
    ("layout_differs", "review", "n_f * 0.2 < 0.45", "''"), ("not_located", "review", "n_lines = 1", "'1'"),
    ("no_date", "warn", "form_type = 'F174' AND n_r = 0", "''"),
    ("loose_fields", "warn", "n_lines < 6 AND n_r = 0", "'24'"), ("extra_fields", "warn", "n_a > 0", "CAST(n_a AS VARCHAR)"),
    ("issuer_missing", "warn", "NOT issuer_signed AND (recipient_signed OR aoc_signed)", "''"),
]


@query("review_issues", "F32", with_cases(
    " UNION ALL ".join(f"SELECT case_id, '{lv}' AS level, '{c}' AS code, {d} AS detail FROM cases WHERE parsed AND {w}" for c, lv, w, d in _RULES)
    + " UNION ALL SELECT case_id, 'review', 'unreadable', 'unreadable' FROM cases WHERE NOT parsed"))
def review_issues(spark, sf):
    return RC.issues(form_cases(spark, sf)).select("case_id", F.inline("issues"))


@query("review_status", "P6", with_cases(
    "SELECT case_id, flagged, flagged AND NOT reviewed AND NOT archived AND NOT rejected AS needs_review FROM (SELECT case_id, reviewed, archived, rejected, NOT parsed OR "
    + " OR ".join(f"coalesce({w}, false)" for c, lv, w, d in _RULES if lv == "review") + " AS flagged FROM cases)"))
def review_status(spark, sf):
    """Flagged by an issue of review level, and still to be looked at."""
    return RC.review_status(RC.issues(form_cases(spark, sf))).select("case_id", "flagged", "needs_review")


@query("returned_copy_check", "F33", with_cases("""
SELECT case_id AS item_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN NOT parsed THEN 'unreadable'
  WHEN o_orderpriority = '1-URGENT' AND NOT issuer_signed THEN 'unsigned' WHEN o_orderpriority = '2-HIGH' AND form_type = 'F10' AND NOT sqccf_processed THEN 'unsigned'
  WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') AND NOT aoc_signed THEN 'unsigned' END AS warning FROM cases"""))
def returned_copy_check(spark, sf):
    items = form_cases(spark, sf).selectExpr(
        "case_id AS item_id", "if(o_orderpriority = '5-LOW', 'new', 'returned') AS kind", "form_type", "error", "slots", "field_overrides",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'issuer_signed' WHEN '2-HIGH' THEN 'sqccf_processed' ELSE 'aoc_signed' END AS step")
    return RC.signed_check(items).select("item_id", "warning")


def roster(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf).where("NOT missing").selectExpr("case_id", "recipient_list", "if(size(recipient_list) > 1 AND n_a > 0, concat(class_year, ', ', class_year), class_year) AS raw_years")
    return RC.build_roster(c, "case_id")


_ROSTER = """roster AS (
  SELECT k AS name_key, max_by(class_year, case_id * 10 + i) AS class_year
  FROM (SELECT case_id, class_year, unnest(party_keys) AS k, unnest(range(len(party_keys))) AS i FROM cases
        WHERE NOT missing AND class_year <> '' AND (len(party_keys) = 1 OR n_a > 0)) GROUP BY 1)"""


@query("roster", "A9", with_cases("SELECT name_key, class_year FROM roster", extra=_ROSTER))
def roster_query(spark, sf):
    return roster(spark, sf)


@query("roster_lookup", "J1", with_cases("""
SELECT case_id, pos, name AS recipient, CASE WHEN len(recipient_list) = 1 THEN p.class_year ELSE coalesce(r.class_year, '') END AS class_year
FROM case_parties p LEFT JOIN roster r ON r.name_key = p.key""", True, _ROSTER))
def roster_lookup(spark, sf):
    c = cases(spark, sf).where("NOT missing AND NOT archived AND parsed").withColumn("date", F.lit(""))
    rows = RC.output_rows(c, roster=roster(spark, sf))
    return rows.select("case_id", "pos", F.col("Name").alias("recipient"), F.col("Class Year").alias("class_year"))


