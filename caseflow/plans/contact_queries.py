"""Contacts and digests over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import name_key
from ..operators import contacts as K
from ..operators import digest as D
from ..operators import reports as R
from ..session import cut_lineage
from .balance_queries import _balances_cte, assessments, settled_events
from .bindings import case_parties, family_sql, given_sql, key_sql, person_sql, person_text, table, with_cases
from .registry import query

_EMAIL_RE = r"[A-Za-z0-9._%+''-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"


def text_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as sheets: a line is a row, a word is a cell."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return d.select("sheet", "row", F.split("line", " ").alias("cells"))


@query("first_addresses", "W6, F23", rf"""
WITH hits AS (SELECT doc_id AS sheet, row, col, unnest(regexp_extract_all(cell, '{_EMAIL_RE}')) AS raw FROM (
  SELECT doc_id, row, unnest(string_split(line, ' ')) AS cell, unnest(range(len(string_split(line, ' ')))) AS col FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents)) WHERE contains(cell, '@')),
e AS (SELECT *, lower(regexp_replace(raw, '^[''.]+|[.'']+$', '', 'g')) AS email FROM hits)
SELECT email, sheet, row, col FROM e QUALIFY row_number() OVER (PARTITION BY email ORDER BY sheet, row, col) = 1""")
def first_addresses(spark, sf):
    return K.addresses(text_cells(spark, sf)).select("email", "sheet", "row", "col")


@query("extracted_contacts", "F24", why_no_sql="layout-free extraction; checked on literal sheets")
def extracted_contacts(spark, sf):
    known = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return K.extract(text_cells(spark, sf), known)


def contact_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sheets of cells per segment: one layout each, some with a heading row."""
    who = "initcap(translate(string(100 + (c_custkey * 31) % 900), '0123456789', 'aeoublnrts'))"
    fam = "initcap(translate(string(1000000 + (c_custkey * 7919) % 8999993), '0123456789', 'aeoublnrts'))"
    mail = "concat('u', c_custkey, '@mail.example.com')"
    c = table(spark, sf, "customer")
    body = c.selectExpr("c_mktsegment AS sheet", "c_custkey + 10 AS row", f"""CASE c_mktsegment
      WHEN 'HOUSEHOLD' THEN array({who}, {fam}, '', {mail}) WHEN 'MACHINERY' THEN array({fam}, {who}, {mail}, '555')
      WHEN 'BUILDING' THEN array('2027', concat({who}, ' ', {fam}), '12', {mail}) WHEN 'FURNITURE' THEN array('x', concat({who}, ' ', {fam}, ' <', {mail}, '>'))
      ELSE array('12', concat(lower({who}), '.', lower({fam}), c_custkey, '@mail.example.com')) END AS cells""")
    head = c.where("c_mktsegment = 'MACHINERY'").select("c_mktsegment").distinct().selectExpr("c_mktsegment AS sheet", "0L AS row", "array('Last Name', 'First Name', 'Email', 'Phone') AS cells")
    return body.unionByName(head)


@query("contact_sheets", "F24", f"""
SELECT {person_sql('c_custkey')} AS name, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN lower({given_sql('c_custkey')}) || '.' || lower({family_sql('c_custkey')}) || c_custkey ELSE 'u' || c_custkey END || '@mail.example.com' AS email,
  c_mktsegment = 'AUTOMOBILE' AS guessed FROM customer""")
def contact_sheets(spark, sf):
    return K.extract(contact_sheet(spark, sf)).select("name", "email", "guessed")


# ---- the registry ------------------------------------------------------------------------------------------

def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts: customers, some tied to the party they are, some to nobody."""
    tied = "c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')"
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", f"if({tied}, {person_text('c_custkey')}, concat({person_text('c_custkey')}, if(c_mktsegment = 'BUILDING', 's', ''))) AS name",
        "concat('u', c_custkey, '@mail.example.com') AS email", f"if({tied}, {person_text('c_custkey')}, '') AS party",
        "if(c_mktsegment = 'HOUSEHOLD', 'same', if(c_mktsegment = 'MACHINERY', 'close', '')) AS match", "c_acctbal < 1000 AS guessed", "c_nationkey < 10 AS auto", "'upload' AS source")
    return K.tie_key(c)


_REG = f"""reg AS (SELECT c_custkey AS id, {person_sql('c_custkey')} || CASE WHEN c_mktsegment = 'BUILDING' THEN 's' ELSE '' END AS name, 'u' || c_custkey || '@mail.example.com' AS email,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN {person_sql('c_custkey')} ELSE '' END AS party, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN {key_sql('c_custkey')} ELSE '' END AS tie,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'same' WHEN 'MACHINERY' THEN 'close' ELSE '' END AS match, c_acctbal < 1000 AS guessed, c_nationkey < 10 AS auto, c_mktsegment AS seg, c_nationkey FROM customer)"""
_PPL = """ppl AS (SELECT key, min_by(name, ord) AS name, count(*) AS cases, coalesce(min_by(class_year, ord) FILTER (WHERE class_year <> ''), '') AS class_year FROM case_parties GROUP BY key)"""


@query("contacts_with_party", "J6", with_cases("""
SELECT id, tie, coalesce(p.class_year, '') AS class_year, coalesce(p.cases, 0) AS cases, p.key IS NOT NULL AS on_file FROM reg LEFT JOIN ppl p ON p.key = tie""", True, _REG + ",\n" + _PPL))
def contacts_with_party(spark, sf):
    return K.with_party(registry(spark, sf), R.parties(case_parties(spark, sf))).select("id", "tie", "class_year", "cases", "on_file")


@query("contact_filters", "P13", f"""WITH {_REG}
SELECT id, party = '' AS unlinked, guessed OR match = 'close' OR party = '' AS "check", auto AS "in", NOT auto AS out, contains(lower(name || ' ' || email || ' ' || party), 'u12') AS hit FROM reg""")
def contact_filters(spark, sf):
    kinds = ("unlinked", "check", "in", "out")
    return registry(spark, sf).select("id", *[K.contact_filter(k).alias(k) for k in kinds], K.contact_filter("all", " U12").alias("hit"))


def _tok(a, b):
    return f"(CASE WHEN {a} = {b} THEN 0 WHEN levenshtein({a}, {b}) <= least(2, least(length({a}), length({b})) // 3) THEN levenshtein({a}, {b}) ELSE 3 END)"


def _dist(x, y):
    g, f = (lambda v: f"split_part(lower({v}), ' ', 1)"), (lambda v: f"split_part(lower({v}), ' ', 2)")
    return f"least({_tok(g(x), g(y))} + {_tok(f(x), f(y))}, {_tok(g(x), f(y))} + {_tok(f(x), g(y))})"


@query("link_suggestions", "J7", with_cases(f"""
, alone AS (SELECT key, name FROM ppl WHERE key NOT IN (SELECT tie FROM reg)), free AS (SELECT id, name FROM reg WHERE party = ''),
d AS (SELECT key, alone.name AS party, id AS contact_id, free.name AS contact, {_dist('alone.name', 'free.name')} AS dist FROM alone, free)
SELECT * FROM d WHERE dist <= 2 AND NOT EXISTS (SELECT 1 FROM reg r WHERE r.id = contact_id AND r.c_nationkey > 20 AND r.seg = 'BUILDING')
  AND NOT EXISTS (SELECT 1 FROM reg r WHERE r.id = contact_id AND r.c_nationkey < 5 AND r.seg = 'BUILDING' AND d.dist > 0 AND d.key = {key_sql('r.id')})""", True, _REG + ",\n" + _PPL))
def link_suggestions(spark, sf):
    reg = cut_lineage(registry(spark, sf))
    people = cut_lineage(R.parties(case_parties(spark, sf)))
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    no = c.where("c_nationkey > 20").selectExpr("c_custkey AS contact_id", f"{person_text('c_custkey')} AS n").select("contact_id", name_key("n").alias("key"))
    ruled = c.where("c_nationkey < 5").selectExpr(f"upper({person_text('c_custkey')}) AS a", f"concat({person_text('c_custkey')}, 's') AS b")
    return K.suggest_links(people, reg, no, ruled)


@query("contact_reachability", "J13", with_cases("""
SELECT w.key, coalesce(p.name, w.key) AS name, (SELECT count(*) FROM reg WHERE tie = w.key) AS emails,
  CASE WHEN p.key IS NULL THEN 'no active paperwork on file' WHEN w.key NOT IN (SELECT tie FROM reg) THEN 'no email on file' END AS reason
FROM (SELECT DISTINCT k AS key FROM (SELECT unnest(party_keys) AS k FROM cases)) w LEFT JOIN ppl p ON p.key = w.key""", True, _REG + ",\n" + _PPL))
def contact_reachability(spark, sf):
    from .bindings import cases

    everyone = cases(spark, sf).select(F.explode("party_keys").alias("key"))
    return K.reachability(everyone, R.parties(case_parties(spark, sf)), registry(spark, sf))


def _import(spark, sf):
    """The sheets imported into a registry that has some of the addresses."""
    pairs = cut_lineage(K.extract(contact_sheet(spark, sf)), "pairs")
    have = registry(spark, sf).where("party <> '' AND auto")
    known = case_parties(spark, sf).groupBy("key").agg(F.max_by("name", "ord").alias("name"), F.max("ord").alias("ord"))
    return have, K.import_contacts(have, pairs, known)


_IMPORT = f"""
, src AS (SELECT c_custkey AS id, {person_sql('c_custkey')} AS name, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN lower({given_sql('c_custkey')}) || '.' || lower({family_sql('c_custkey')}) || c_custkey ELSE 'u' || c_custkey END || '@mail.example.com' AS email,
    c_mktsegment = 'AUTOMOBILE' AS guessed, {key_sql('c_custkey')} AS key FROM customer),
far AS (SELECT s.id, s.name, p.name AS cand, {_dist('s.name', 'p.name')} AS dist FROM src s, ppl p WHERE s.key NOT IN (SELECT key FROM ppl)),
near AS (SELECT id, min_by(cand, dist) AS cand FROM far f WHERE dist <= 2 AND dist = (SELECT min(dist) FROM far g WHERE g.id = f.id) GROUP BY id HAVING count(*) = 1),
imp AS (SELECT s.email, coalesce(p.name, n.cand, s.name) AS name, coalesce(p.name, n.cand, '') AS party, CASE WHEN p.key IS NOT NULL THEN 'same' WHEN n.id IS NOT NULL THEN 'close' ELSE '' END AS match,
    s.guessed, CASE WHEN p.key IS NULL AND n.id IS NOT NULL THEN s.name ELSE '' END AS sheet_name, EXISTS (SELECT 1 FROM reg WHERE reg.email = s.email AND party <> '' AND auto) AS existing
  FROM src s LEFT JOIN ppl p ON p.key = s.key LEFT JOIN near n ON n.id = s.id)
"""


@query("contact_import", "M4", with_cases(_IMPORT + "SELECT * FROM imp", True, _REG + ",\n" + _PPL))
def contact_import(spark, sf):
    return _import(spark, sf)[1]


@query("contact_merge", "M4", with_cases(_IMPORT + """
SELECT email, name, party, match, guessed, false AS auto FROM imp WHERE NOT existing
UNION ALL SELECT email, name, party, match, guessed, auto FROM reg WHERE party <> '' AND auto""", True, _REG + ",\n" + _PPL))
def contact_merge(spark, sf):
    have, classified = _import(spark, sf)
    return K.merge_contacts(have, classified).drop("source")


@query("import_report", "A18", with_cases(_IMPORT + """
SELECT count(*) AS found, count(*) FILTER (WHERE NOT existing) AS added, count(*) FILTER (WHERE existing) AS existing, count(*) FILTER (WHERE NOT existing AND match <> '') AS tied,
  count(*) FILTER (WHERE NOT existing AND match = 'close') AS close, count(*) FILTER (WHERE NOT existing AND match = '') AS untied,
  count(*) FILTER (WHERE NOT existing AND guessed) AS guessed, count(*) FILTER (WHERE NOT existing AND name = '') AS nameless FROM imp""", True, _REG + ",\n" + _PPL))
def import_report(spark, sf):
    return K.import_report(_import(spark, sf)[1])


@query("link_answers", "M5", f"""WITH {_REG}
SELECT id, CASE WHEN seg = 'BUILDING' AND c_nationkey < 10 THEN 'New Party' ELSE party END AS party, CASE WHEN seg = 'BUILDING' AND c_nationkey < 10 THEN 'same' ELSE match END AS match,
  CASE WHEN seg = 'BUILDING' AND c_nationkey >= 10 THEN 'new party' END AS declined FROM reg WHERE seg <> 'HOUSEHOLD'""")
def link_answers(spark, sf):
    reg = registry(spark, sf)
    b = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    answers = b.selectExpr("c_custkey AS contact_id", "' New  Party' AS party", "c_nationkey < 10 AS yes")
    declined = spark.createDataFrame([], "contact_id bigint, key string")
    linked, refused = K.answer_links(reg, declined, answers)
    gone = table(spark, sf, "customer").where("c_mktsegment = 'HOUSEHOLD'").selectExpr("c_custkey AS id")
    linked, refused = K.remove_contacts(linked, refused, gone)
    return linked.join(refused.select(F.col("contact_id").alias("id"), F.col("key").alias("declined")), "id", "left").select("id", "party", "match", "declined")


# ---- digests ---------------------------------------------------------------------------------------------------

_DONE = {"issuer_signed": "Issuer signature", "sqccf_processed": "SQ/CCF processing", "cadet_cc_initialed": "Cadet Commander initials", "recipient_signed": "Recipient signature", "aoc_signed": "AOC/AMT signature"}
_LIST = lambda v: "concat_ws(', ', " + ", ".join(f"CASE WHEN {s} = {v} THEN '{t}' END" for s, t in _DONE.items()) + ")"


@query("digest_case_lines", "F34", with_cases(f"""
SELECT key, case_id, pos_name, CASE WHEN rejected THEN 'Rejected, so nothing from this form counts' WHEN todo <> '' THEN 'Waiting on: ' || split_part(todo, ', ', 1) ELSE 'Fully processed' END AS status,
  coalesce(strftime(date_iso, '%-d %b %y'), 'No date') || ' - ' || CASE form_type WHEN 'F174' THEN 'AF 174' ELSE 'Form 10' END || CASE pos_neg WHEN 'Pos' THEN ', Positive' WHEN 'Neg' THEN ', Negative' ELSE '' END
    || CASE WHEN reason_category <> '' THEN ' - ' || reason_category ELSE '' END AS head,
  CASE WHEN rejected THEN '' ELSE trim(CASE WHEN done <> '' THEN 'Done: ' || done || '.' ELSE '' END || CASE WHEN todo <> '' THEN ' Still to do: ' || todo || '.' ELSE '' END) END AS steps
FROM (SELECT *, name AS pos_name, {_LIST('true')} AS done, {_LIST('false')} AS todo FROM case_parties)""".replace(", pos_name,", ",").replace("name AS pos_name, ", ""), True))
def digest_case_lines(spark, sf):
    return D.case_lines(case_parties(spark, sf)).select("key", "case_id", "status", "head", "steps")


@query("digest_totals_line", "F34, A13", with_cases("""
SELECT key, 'Totals: ' || n || ' form' || CASE WHEN n = 1 THEN '' ELSE 's' END || CASE WHEN kinds <> '' THEN ' (' || kinds || ')' ELSE '' END || CASE WHEN sanctions <> '' THEN '; ' || sanctions ELSE '' END || '.' AS totals
FROM (SELECT key, n, concat_ws(', ', CASE WHEN neg > 0 THEN neg || ' negative' END, CASE WHEN pos > 0 THEN pos || ' positive' END, CASE WHEN rej > 0 THEN rej || ' rejected' END) AS kinds,
    concat_ws(', ', CASE WHEN d > 0 THEN d || ' demerit' || CASE WHEN d = 1 THEN '' ELSE 's' END END, CASE WHEN t > 0 THEN t || ' tour' || CASE WHEN t = 1 THEN '' ELSE 's' END END,
      CASE WHEN c > 0 THEN c || ' confinement' || CASE WHEN c = 1 THEN '' ELSE 's' END END) AS sanctions
  FROM (SELECT key, count(*) AS n, count(*) FILTER (WHERE pos_neg <> 'Pos' AND NOT rejected) AS neg, count(*) FILTER (WHERE pos_neg = 'Pos' AND NOT rejected) AS pos, count(*) FILTER (WHERE rejected) AS rej,
      sum(CASE WHEN pos_neg <> 'Pos' AND NOT rejected THEN demerits_n ELSE 0 END) AS d, sum(CASE WHEN pos_neg <> 'Pos' AND counted THEN tours_n ELSE 0 END) AS t,
      sum(CASE WHEN pos_neg <> 'Pos' AND counted THEN confinements_n ELSE 0 END) AS c FROM case_parties GROUP BY key))""", True))
def digest_totals_line(spark, sf):
    return D.totals_line(R.digest_totals(case_parties(spark, sf)))


@query("balance_lines", "F34", _balances_cte() + """
SELECT party AS key, 'tours' AS kind, CASE WHEN tours_left > 0 THEN 'Tours: ' || tours_left::BIGINT || ' left to serve' || CASE WHEN tours_served > 0 THEN ' (' || tours_served::BIGINT || ' served of ' || tours_assigned::BIGINT || ')' ELSE '' END
  ELSE 'Tours: none left to serve (all ' || tours_assigned::BIGINT || ' served)' END AS line FROM b WHERE tours_assigned > 0 OR tours_left > 0
UNION ALL SELECT party, 'confinements', CASE WHEN confinements_left > 0 THEN 'Confinements: ' || confinements_left::BIGINT || ' left to serve' || CASE WHEN confinements_served > 0 THEN ' (' || confinements_served::BIGINT || ' served of ' || confinements_assigned::BIGINT || ')' ELSE '' END
  ELSE 'Confinements: none left to serve (all ' || confinements_assigned::BIGINT || ' served)' END FROM b WHERE confinements_assigned > 0 OR confinements_left > 0""")
def balance_lines(spark, sf):
    from ..operators.balances import balances

    return D.balance_lines(balances(assessments(spark, sf), settled_events(spark, sf)))


@query("digest_rows", "F34", why_no_sql="all lines of every digest; its parts have SQL of their own")
def digest_rows(spark, sf):
    return D.digest_rows(case_parties(spark, sf))


@query("attachment_pick", "W8", """
WITH RECURSIVE i AS (SELECT o_custkey AS party, o_orderkey AS ord, CAST(round(o_totalprice * 20) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
w AS (SELECT party, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS picked, 0::BIGINT AS size FROM (SELECT DISTINCT party FROM i)
  UNION ALL SELECT w.party, i.k, CASE WHEN w.n < 10 AND w.used + i.size <= 18874368 THEN w.used + i.size ELSE w.used END, CASE WHEN w.n < 10 AND w.used + i.size <= 18874368 THEN w.n + 1 ELSE w.n END,
    CASE WHEN w.n < 10 AND w.used + i.size <= 18874368 THEN i.ord END, i.size FROM w JOIN i ON i.party = w.party AND i.k = w.k + 1)
SELECT party, picked AS item, size FROM w WHERE picked IS NOT NULL""")
def attachment_pick(spark, sf):
    items = table(spark, sf, "orders").selectExpr("o_custkey AS party", "o_orderkey AS ord", "o_orderkey AS item", "cast(round(o_totalprice * 20) AS bigint) AS size")
    return D.capped_pick(items).select("party", "item", "size")


@query("held_rounds", "T3", """
SELECT date_trunc('hour', ts) AS round, count(DISTINCT user_id) AS parties, count(DISTINCT user_id) > 12 AS held FROM events GROUP BY 1""")
def held_rounds(spark, sf):
    e = table(spark, sf, "events").selectExpr("date_trunc('hour', ts) AS round", "user_id AS party")
    return D.circuit_breaker(e, 12)

