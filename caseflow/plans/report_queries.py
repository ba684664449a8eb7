"""Reports, filters, rankings and exports over case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import month_label
from ..operators import reports as R
from ..operators.scale import PageIndex
from ..sources import io
from .bindings import case_parties, cases, table, with_cases
from .registry import query

_F10N = "CASE WHEN form_type = 'F10' THEN 1 ELSE 0 END"


@query("lifecycle_pools", "P5", with_cases("""
SELECT count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_parsed) AS parsed,
  count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE needs_review OR n_incomplete > 0) AS in_queue FROM cases"""))
def lifecycle_pools(spark, sf):
    return cases(spark, sf).agg(
        F.count_if(R.active()).alias("active"), F.count_if(R.parsed()).alias("parsed"),
        F.count_if("archived").alias("archived"), F.count_if(R.in_queue()).alias("in_queue"))


@query("next_step", "P8", with_cases("SELECT case_id, first_open AS next_step FROM cases"))
def next_step(spark, sf):
    return cases(spark, sf).select("case_id", R.next_step().alias("next_step"))


_OPEN = ", ".join(f"CASE WHEN {s} = false THEN '{s}' END" for s in V.STEPS)
_DONE = " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in V.STEPS)
_APPLICABLE = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 END" for s in V.STEPS)
_NEXT_LABEL = "CASE " + " ".join(f"WHEN {s} = false THEN '{V.STEP_LABELS[s]}'" for s in V.STEPS) + " ELSE '' END"


@query("route_progress", "P9", with_cases(
    f"SELECT case_id, waiting AND parsed AS awaiting, concat_ws(',', {_OPEN}) AS open_steps, {_APPLICABLE} AS steps, {_DONE} AS done, {_NEXT_LABEL} AS next FROM cases"))
def route_progress(spark, sf):
    p = R.progress()
    return cases(spark, sf).select(
        "case_id", R.awaiting().alias("awaiting"), F.array_join(R.open_steps(), ",").alias("open_steps"),
        p["steps"].alias("steps"), p["done"].alias("done"), p["next"].alias("next"))


_HAY = "lower(concat_ws(' ', filename, recipients, reason_category, reason_details, issuer, class_year, notes))"


@query("text_search", "P10", with_cases(
    f"SELECT case_id, filename FROM cases WHERE contains({_HAY}, 'household') AND contains({_HAY}, 'neg') AND contains({_HAY}, 'lines 4')".replace("'lines 4'", "'202'")))
def text_search(spark, sf):
    return cases(spark, sf).where(R.search(R.SEARCH_COLUMNS, " HouseHold neg  202")).select("case_id", "filename")


@query("filtered_cases", "P11", with_cases(
    f"SELECT case_id FROM cases WHERE form_type = 'F10' AND pos_neg = 'Neg' AND first_open NOT IN ('complete', 'rejected') AND contains({_HAY}, 'low')"))
def filtered_cases(spark, sf):
    return cases(spark, sf).where(R.matches({"type": "F10", "pn": "Neg", "step": "open"}, "low")).select("case_id")


@query("scope_members", "P12, U1", with_cases("""
SELECT case_id, (pos_neg <> 'Pos' AND NOT rejected AND waiting) OR rejected AS chosen, pos_neg <> 'Pos' AND NOT rejected AS negative,
  pos_neg = 'Pos' AND NOT rejected AS positive, NOT rejected AND waiting AS in_progress FROM cases"""))
def scope_members(spark, sf):
    return cases(spark, sf).select(
        "case_id", R.in_scope(["outstanding_negative", "rejected", "rejected"]).alias("chosen"),
        *[R.in_scope(s).alias(s) for s in ("negative", "positive", "in_progress")])


@query("export_selection", "P14", with_cases("SELECT case_id, date_iso FROM cases WHERE is_parsed AND NOT logged AND pos_neg = 'Neg' ORDER BY date_iso NULLS LAST, filename"))
def export_selection(spark, sf):
    return cases(spark, sf).where(R.export_filter("unlogged", "Neg")).orderBy(F.asc_nulls_last("date_iso"), "filename").select("case_id", "date_iso")


_OUTCOME = """CASE WHEN pos_neg = 'Pos' THEN concat_ws('; ', CASE WHEN cdna <> '' THEN 'CDNA: ' || cdna END, CASE WHEN passes <> '' THEN 'Passes: ' || passes END)
  ELSE concat_ws('; ', CASE WHEN form_type = 'F10' AND demerits_n > 0 THEN 'Demerits: ' || demerits_n END,
    CASE WHEN form_type = 'F10' THEN 'Tours: ' || tours_n || ' tours' END,
    CASE WHEN form_type = 'F10' AND confinements_n > 0 THEN 'Confinements: ' || confinements_n END, CASE WHEN other <> '' THEN other END) END"""


@query("outcome_text", "P15", with_cases(f"""
SELECT case_id, CASE WHEN rejected OR t = '' THEN '' WHEN counted THEN t ELSE 'Pending until fully signed: ' || t END AS outcome
FROM (SELECT *, {_OUTCOME} AS t FROM cases)"""))
def outcome_text(spark, sf):
    return cases(spark, sf).select("case_id", R.outcomes(F.col("counted")).alias("outcome"))


@query("overview_kpis", "A4", with_cases("""
SELECT count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_parsed) AS parsed,
  count(*) FILTER (WHERE is_parsed AND pos_neg = 'Neg') AS negative, count(*) FILTER (WHERE is_parsed AND pos_neg = 'Pos') AS positive,
  count(*) FILTER (WHERE is_parsed AND waiting) AS awaiting, count(*) FILTER (WHERE is_active AND (needs_review OR n_incomplete > 0)) AS review,
  count(*) FILTER (WHERE is_parsed AND NOT logged) AS unlogged,
  CAST(sum(tours_n * len(party_keys)) FILTER (WHERE is_parsed AND counted) AS DOUBLE) AS tours,
  CAST(sum(confinements_n * len(party_keys)) FILTER (WHERE is_parsed AND counted) AS DOUBLE) AS confinements,
  CAST(sum(demerits_n * len(party_keys)) FILTER (WHERE is_parsed) AS DOUBLE) AS demerits,
  (SELECT count(DISTINCT k) FROM (SELECT unnest(party_keys) AS k FROM cases WHERE is_parsed)) AS parties FROM cases"""))
def overview_kpis(spark, sf):
    return R.kpis(cases(spark, sf))


_STEP_ROWS = " UNION ALL ".join(
    f"SELECT '{s}' AS step, count({s}) AS applicable, count(*) FILTER (WHERE {s}) AS done, "
    f"CASE WHEN count({s}) > 0 THEN round(100.0 * count(*) FILTER (WHERE {s}) / count({s}), 4) ELSE 0 END AS pct FROM cases WHERE is_parsed" for s in V.STEPS)


@query("step_completion", "A5", with_cases(f"SELECT step, applicable, done, CAST(pct AS DOUBLE) AS pct FROM ({_STEP_ROWS})"))
def step_completion(spark, sf):
    return R.step_completion(cases(spark, sf))


@query("month_histogram", "A6", with_cases("""
SELECT CAST(s.month AS DATE) AS month, coalesce(neg, 0) AS neg, coalesce(pos, 0) AS pos
FROM (SELECT unnest(generate_series(least(greatest(lo, hi - INTERVAL 11 MONTH), hi - INTERVAL 5 MONTH), hi, INTERVAL 1 MONTH)) AS month
      FROM (SELECT CAST(min(date_trunc('month', date_iso)) AS TIMESTAMP) AS lo, CAST(max(date_trunc('month', date_iso)) AS TIMESTAMP) AS hi FROM cases WHERE is_parsed)) s
LEFT JOIN (SELECT CAST(date_trunc('month', date_iso) AS TIMESTAMP) AS month, count(*) FILTER (WHERE pos_neg <> 'Pos') AS neg, count(*) FILTER (WHERE pos_neg = 'Pos') AS pos
      FROM cases WHERE is_parsed AND date_iso IS NOT NULL GROUP BY 1) b ON b.month = s.month"""))
def month_histogram(spark, sf):
    return R.month_histogram(cases(spark, sf))


@query("top_reasons", "A7", with_cases("""
SELECT CASE WHEN reason_category = '' THEN 'Unspecified' ELSE trim(reason_category) END AS reason,
  count(*) FILTER (WHERE pos_neg <> 'Pos') AS neg, count(*) FILTER (WHERE pos_neg = 'Pos') AS pos, count(*) AS total
FROM cases WHERE is_parsed GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 7"""))
def top_reasons(spark, sf):
    return R.top_reasons(cases(spark, sf))


def _facet_sql() -> str:
    step = {"all": "true", "review": "needs_review", "open": "first_open NOT IN ('complete', 'rejected')"}
    typ, pn = "form_type = 'F10'", "pos_neg = 'Neg'"
    rows = []
    for o in R.FACETS["step"]:
        rows.append(("step", o, f"{typ} AND {pn} AND {step.get(o, f'first_open = {chr(39)}{o}{chr(39)}')}", o == "all"))
    for o in R.FACETS["type"]:
        rows.append(("type", o, f"{pn}" + ("" if o == "all" else f" AND form_type = '{o}'"), o in ("all", "F10")))
    for o in R.FACETS["pn"]:
        rows.append(("pn", o, f"{typ}" + ("" if o == "all" else f" AND pos_neg = '{o}'"), o in ("all", "Neg")))
    body = " UNION ALL ".join(
        f"SELECT '{g}' AS facet, '{o}' AS \"option\", count(*) FILTER (WHERE {c}) AS n, {str(k).lower()} AS keep FROM cases WHERE NOT archived" for g, o, c, k in rows)
    return with_cases(f'SELECT facet, "option", n FROM ({body}) WHERE keep OR n > 0')


@query("facet_counts", "A8", _facet_sql())
def facet_counts(spark, sf):
    return R.facet_counts(cases(spark, sf), {"type": "F10", "pn": "Neg"})


_INDEX = """
SELECT key, min_by(name, ord) AS name, count(*) AS cases, count(*) FILTER (WHERE pos_neg <> 'Pos') AS neg, count(*) FILTER (WHERE pos_neg = 'Pos') AS pos,
  CAST(sum(demerits_n) AS DOUBLE) AS demerits, CAST(sum(CASE WHEN counted THEN tours_n ELSE 0 END) AS DOUBLE) AS tours,
  CAST(sum(CASE WHEN counted THEN confinements_n ELSE 0 END) AS DOUBLE) AS confinements, max(date_iso) AS last_date,
  coalesce(min_by(class_year, ord) FILTER (WHERE class_year <> ''), '') AS class_year
FROM case_parties WHERE NOT rejected GROUP BY key"""


def _index(spark, sf):
    return R.party_index(case_parties(spark, sf).where(~F.col("rejected")))


@query("party_index", "A3", with_cases(_INDEX, True))
def party_index(spark, sf):
    return _index(spark, sf)


@query("party_ranking", "O3", with_cases(f"SELECT key, neg, cases FROM ({_INDEX}) ORDER BY neg DESC, cases DESC, name", True))
def party_ranking(spark, sf):
    return R.rank_parties(_index(spark, sf)).select("key", "neg", "cases")


@query("parties_with_cases", "A10", with_cases("""
SELECT key, min_by(name, ord) AS name, count(*) AS cases, coalesce(min_by(class_year, ord) FILTER (WHERE class_year <> ''), '') AS class_year
FROM case_parties GROUP BY key""", True))
def parties_with_cases(spark, sf):
    return R.parties(case_parties(spark, sf))


@query("known_names", "A11", with_cases(
    "SELECT k AS key, max_by(n, case_id * 10 + i) AS name FROM (SELECT case_id, unnest(party_keys) AS k, unnest(recipient_list) AS n, "
    "unnest(range(len(party_keys))) AS i FROM cases WHERE NOT missing AND parsed) GROUP BY k"))
def known_names(spark, sf):
    from ..functions import name_key

    c = cases(spark, sf).where(~F.col("missing") & F.col("parsed"))
    rows = c.select("case_id", F.posexplode("recipient_list").alias("pos", "name")).select(
        "name", name_key("name").alias("key"), (F.col("case_id") * 10 + F.col("pos")).alias("ord"))
    return R.known_names(rows)


_SCOPE = {
    "all": "true", "negative": "pos_neg <> 'Pos' AND NOT rejected", "positive": "pos_neg = 'Pos' AND NOT rejected",
    "outstanding_negative": "pos_neg <> 'Pos' AND NOT rejected AND waiting", "in_progress": "NOT rejected AND waiting", "rejected": "rejected",
}


@query("party_scope_counts", "A12", with_cases("SELECT key, " + ", ".join(
    f'count(*) FILTER (WHERE {c}) AS "{s}", count(*) FILTER (WHERE ({c}) AND (rejected OR waiting)) AS {s}_open' for s, c in _SCOPE.items()
) + " FROM case_parties GROUP BY key", True))
def party_scope_counts(spark, sf):
    return R.scope_counts(case_parties(spark, sf))


@query("digest_totals", "A13", with_cases("""
SELECT key, count(*) AS forms, count(*) FILTER (WHERE pos_neg <> 'Pos' AND NOT rejected) AS neg, count(*) FILTER (WHERE pos_neg = 'Pos' AND NOT rejected) AS pos,
  count(*) FILTER (WHERE rejected) AS rejected,
  CAST(sum(CASE WHEN pos_neg <> 'Pos' AND NOT rejected THEN demerits_n ELSE 0 END) AS DOUBLE) AS demerits,
  CAST(sum(CASE WHEN pos_neg <> 'Pos' AND NOT rejected AND counted THEN tours_n ELSE 0 END) AS DOUBLE) AS tours,
  CAST(sum(CASE WHEN pos_neg <> 'Pos' AND NOT rejected AND counted THEN confinements_n ELSE 0 END) AS DOUBLE) AS confinements
FROM case_parties GROUP BY key""", True))
def digest_totals(spark, sf):
    return R.digest_totals(case_parties(spark, sf))


@query("cases_per_name", "A14", with_cases("SELECT name, count(*) AS n FROM case_parties GROUP BY name", True))
def cases_per_name(spark, sf):
    return R.name_counts(case_parties(spark, sf))


@query("navigation_badges", "A20", with_cases("""
SELECT count(*) FILTER (WHERE is_active) AS paperwork, count(*) FILTER (WHERE is_active AND (needs_review OR n_incomplete > 0)) AS review,
  count(*) FILTER (WHERE is_parsed AND NOT logged) AS export, count(*) FILTER (WHERE archived) AS archive,
  count(*) FILTER (WHERE is_parsed AND sqccf_processed = false) AS bulk_sqccf_processed,
  count(*) FILTER (WHERE is_parsed AND cadet_cc_initialed = false) AS bulk_cadet_cc_initialed FROM cases"""))
def navigation_badges(spark, sf):
    return R.badges(cases(spark, sf))


@query("packet_index", "W1", with_cases("""
SELECT case_id, coalesce(sum(n_lines) OVER (ORDER BY coalesce(date_iso, DATE '9999-12-31'), filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
  + greatest(1, CAST(ceil(count(*) OVER () / 41.0) AS BIGINT)) AS start_page
FROM cases WHERE is_parsed AND first_open = 'aoc_signed'""").replace("coalesce(sum(n_lines)", "coalesce(CAST(sum(n_lines)").replace("1 PRECEDING), 0)", "1 PRECEDING) AS BIGINT), 0)"))
def packet_index(spark, sf):
    c = cases(spark, sf).where(R.parsed() & (R.next_step() == "aoc_signed"))
    return R.packet_index(c.select("case_id", "filename", "date_iso", "page_count")).select("case_id", "start_page")


@query("list_page", "W9", with_cases("SELECT case_id, filename FROM cases WHERE is_parsed ORDER BY filename LIMIT 50 OFFSET 100"))
def list_page(spark, sf):
    return PageIndex(cases(spark, sf).where(R.parsed()).select("case_id", "filename"), [F.col("filename")]).page(2, 50)


@query("deep_page", "W9", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40 OFFSET 5000""")
def deep_page(spark, sf):
    """The 125th page of all lines, dearest first."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return PageIndex(lines, order).page(125, 40).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("snapshot_order", "O1", with_cases(
    "SELECT case_id, filename FROM cases ORDER BY coalesce(CAST(date_iso AS VARCHAR), '') || lower(filename) DESC"))
def snapshot_order(spark, sf):
    return R.snapshot_order(cases(spark, sf)).select("case_id", "filename")


@query("sorted_list", "O2", with_cases("SELECT case_id, issuer FROM cases WHERE NOT archived ORDER BY lower(issuer) DESC, filename"))
def sorted_list(spark, sf):
    return R.sort_list(cases(spark, sf).where(~F.col("archived")), "issuer", True).select("case_id", "issuer")


@query("review_queue", "O5, U2", with_cases("""
SELECT case_id, CASE WHEN needs_review THEN 0 WHEN n_incomplete > 0 THEN 1 ELSE 2 END AS queue FROM cases
WHERE is_active AND (needs_review OR n_incomplete > 0 OR (flagged AND reviewed))"""))
def review_queue(spark, sf):
    return R.review_queue(cases(spark, sf)).select("case_id", "queue")


@query("month_labels", "F14", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS short, strftime(o_orderdate, '%Y-%m') AS iso, strftime(o_orderdate, '%B %Y') AS name_year, CAST(month(o_orderdate) AS VARCHAR) AS number, strftime(o_orderdate, '%B') AS name FROM orders")
def month_labels(spark, sf):
    from .bindings import table

    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", *[month_label(d, f).alias(f) for f in ("short", "iso", "name_year", "number", "name")])


# ---- exports ----------------------------------------------------------------------------------------------

_ROWS = """
SELECT case_id, pos, coalesce(CAST(date_iso AS VARCHAR), '') AS "Date",
  CASE WHEN len(recipient_list) = 1 THEN class_year ELSE '' END AS "Class Year", form_type AS "Form Type", reason_category AS "Reason Category",
  reason_details AS "Reason Details", coalesce(strftime(date_iso, '%B'), '') AS "Month", name AS "Name", issuer AS "Issuer", pos_neg AS "Pos/Neg",
  cdna AS "CDNA", passes AS "Passes", CASE WHEN form_type = 'F10' THEN CAST(demerits_n AS VARCHAR) ELSE '' END AS "Demerits",
  CASE WHEN form_type = 'F10' THEN tours_n || ' tours' ELSE '' END AS "Tours",
  CASE WHEN form_type = 'F10' THEN CAST(confinements_n AS VARCHAR) ELSE '' END AS "Confinements", other AS "Other" FROM case_parties"""


def _output(spark, sf):
    from ..operators.records import output_rows

    c = cases(spark, sf).where(~F.col("missing") & ~F.col("archived") & F.col("parsed"))
    return output_rows(c.withColumn("date", F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), F.lit(""))))


@query("output_rows", "F16", with_cases(_ROWS, True))
def output_rows_query(spark, sf):
    return _output(spark, sf)


@query("tsv_export", "S7", with_cases(f"SELECT * EXCLUDE (case_id, pos) FROM ({_ROWS.strip()} WHERE NOT logged)", True))
def tsv_export(spark, sf):
    from ..session import scratch_path

    c = cases(spark, sf)
    rows = _output(spark, sf).join(c.select("case_id", "filename", "date_iso"), "case_id")
    ids = c.where(~F.col("logged")).select("case_id")
    out = scratch_path(spark, "tsv")
    io.export_tsv(rows, out, ids, header=False)
    schema = ", ".join(f"`{n}` string" for n in V.OUTPUT_COLUMNS)
    return spark.read.option("sep", "\t").option("quote", "").schema(schema).csv(out).na.fill("")


@query("step_folder_counts", "S8", with_cases("""
SELECT CASE WHEN parsed THEN first_open ELSE 'skipped' END AS next_step, count(*) AS n FROM cases WHERE is_active GROUP BY 1"""))
def step_folder_counts(spark, sf):
    return io.step_folder_counts(cases(spark, sf))


@query("split_by_step", "S8", with_cases("SELECT case_id, first_open AS next_step FROM cases WHERE is_parsed"))
def split_by_step(spark, sf):
    from ..session import scratch_path

    out = scratch_path(spark, "steps")
    io.split_by_step(cases(spark, sf).select("case_id", "filename", "parsed", "missing", "archived", "rejected", *V.STEPS), out)
    return spark.read.parquet(out).select("case_id", "next_step")


@query("conduct_log", "S9", with_cases("""
SELECT case_id, CAST(pos AS INT) AS pos, coalesce(CAST(date_diff('day', DATE '1899-12-30', date_iso) AS VARCHAR), 'about 1994') AS "Date", nullif(class_year, '') AS "Class Year", form_type AS "Form Type",
  nullif(reason_category, '') AS "Reason Category", reason_details AS "Description", strftime(date_iso, '%Y-%m') AS "Month", coalesce(r.spelling, p.name) AS "Recipient", issuer AS "Issuer",
  nullif(pos_neg, '') AS "Pos/Neg", CASE WHEN cdna <> '' THEN '3' END AS "CDNA", CASE WHEN passes <> '' THEN '2.5' END AS "Passes",
  CASE WHEN form_type = 'F10' THEN CAST(demerits_n AS VARCHAR) END AS "Demerits", CASE WHEN form_type = 'F10' THEN tours_n || ' tours' END AS "Tours",
  CASE WHEN form_type = 'F10' THEN CAST(confinements_n AS VARCHAR) END AS "Confinements", nullif(other, '') AS "Other",
  CASE WHEN rejected THEN 'Rejected' WHEN complete THEN 'Complete' ELSE 'In progress' END AS "Status", squadron AS "Squadron"
FROM case_parties p LEFT JOIN (SELECT DISTINCT name, upper(name) AS spelling FROM case_parties WHERE party_id % 10 = 0 AND pos = 0) r ON r.name = p.name""", True))
def conduct_log(spark, sf):
    parties = case_parties(spark, sf)
    respell = parties.where("party_id % 10 = 0 AND pos = 0").select("name", F.upper("name").alias("spelling")).distinct()
    rows = parties.selectExpr(
        "case_id", "pos", "date_iso", "if(date_iso IS NULL, 'about 1994', '') AS date", "class_year", "form_type", "reason_category", "reason_details",
        "coalesce(date_format(date_iso, 'yyyy-MM'), '') AS month", "name AS recipient", "issuer", "pos_neg", "if(cdna <> '', '03.0', '') AS cdna", "if(passes <> '', '2.50', '') AS passes", "demerits", "tours",
        "confinements", "other", "filename", "rejected", "complete", "concat(' ', squadron, '  ') AS squadron", "missing", "archived", "parsed")
    keyed = rows.withColumn("keys", F.concat_ws("|", "case_id", "pos"))
    out = io.push_columns(keyed, [*V.PUSH_COLUMNS, ("Squadron", "squadron"), ("keys", "keys")], respell)
    part = F.split("keys", r"\|")
    return out.withColumns({"case_id": F.get(part, F.lit(0)).cast("bigint"), "pos": F.get(part, F.lit(1)).cast("int")}).drop("keys", "sort_date", "sort_name")


@query("awaiting_step", "S10", with_cases("SELECT case_id FROM cases WHERE is_parsed AND recipient_signed = false"))
def awaiting_step(spark, sf):
    return io.awaiting_step(cases(spark, sf), "recipient_signed").select("case_id")
