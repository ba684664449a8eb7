"""Balances and settlement-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import days_ago, name_key
from ..operators import balances as B
from ..operators import reports as R
from ..operators.match import resolve_parties
from ..session import cut_lineage
from .bindings import (
    case_names, case_parties, family, family_sql, given, given_sql, key_sql, lines_per_case, person, person_sql, table, with_cases,
)
from .registry import query

CUTOFF = "1998-07-01"


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases of their customer; returned lines are tours, accepted ones confinements."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "case_id")
    j = o.join(lines_per_case(spark, sf), "case_id", "left")
    return j.select(
        F.col("o_custkey").alias("party"), person(F.col("o_custkey")).alias("name"), "case_id", F.col("case_id").alias("ord"),
        F.lit("").alias("class_year"), (F.col("o_orderstatus") == "F").alias("counted"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "Pos").otherwise("Neg").alias("pos_neg"),
        F.col("o_orderdate").cast("date").alias("date_iso"),
        F.coalesce("n_r", F.lit(0)).cast("double").alias("tours"), F.coalesce("n_a", F.lit(0)).cast("double").alias("confinements"),
    )


def settled_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where((F.col("value") > 50) & F.col("event_type").isin("purchase", "signup"))
    return e.select(
        F.col("user_id").alias("party"), person(F.col("user_id")).alias("name"),
        F.when(F.col("event_type") == "purchase", "tour").otherwise("confinement").alias("kind"), F.lit(1.0).alias("units"),
    )


def _balances_cte(before: str | None = None) -> str:
    cut = f" AND CAST(o_orderdate AS DATE) < DATE '{before}'" if before else ""
    due = f"o_orderstatus = 'F' AND o_orderpriority <> '3-MEDIUM'{cut}"
    return f"""WITH li AS (
  SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS n_r,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS n_a FROM lineitem GROUP BY 1),
a AS (
  SELECT o_custkey AS party, count(*) AS forms,
    sum(CASE WHEN {due} THEN coalesce(n_r, 0) ELSE 0 END) AS ta, sum(CASE WHEN {due} THEN coalesce(n_a, 0) ELSE 0 END) AS ca
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1),
s AS (
  SELECT user_id AS party, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS ts,
    CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS cs
  FROM events WHERE value > 50 AND event_type IN ('purchase', 'signup') GROUP BY 1),
b AS (
  SELECT coalesce(a.party, s.party) AS party, a.party IS NOT NULL AS on_file, coalesce(forms, 0) AS forms,
    coalesce(ta, 0) AS tours_assigned, coalesce(ts, 0) AS tours_served,
    greatest(0, coalesce(ta, 0) - coalesce(ts, 0)) AS tours_left, greatest(0, coalesce(ts, 0) - coalesce(ta, 0)) AS tours_over,
    coalesce(ca, 0) AS confinements_assigned, coalesce(cs, 0) AS confinements_served,
    greatest(0, coalesce(ca, 0) - coalesce(cs, 0)) AS confinements_left,
    greatest(0, coalesce(cs, 0) - coalesce(ca, 0)) AS confinements_over
  FROM a FULL OUTER JOIN s ON a.party = s.party)
"""


_ALL = f"SELECT *, {person_sql('party')} AS name, '' AS class_year FROM b"


def _b(spark: SparkSession, sf: str, before: str | None = None) -> DataFrame:
    return B.balances(assessments(spark, sf), settled_events(spark, sf), before)


@query("balances", "A1", _balances_cte() + _ALL)
def balances_all(spark, sf):
    return _b(spark, sf)


@query("balances_before_cutoff", "A1", _balances_cte(CUTOFF) + _ALL)
def balances_cutoff(spark, sf):
    return _b(spark, sf, CUTOFF)


@query("balance_totals", "A2", _balances_cte() + """
SELECT sum(tours_assigned) AS tours_assigned, sum(tours_served) AS tours_served, sum(tours_left) AS tours_left,
  sum(confinements_assigned) AS confinements_assigned, sum(confinements_served) AS confinements_served,
  sum(confinements_left) AS confinements_left, count(*) FILTER (WHERE tours_left > 0 OR confinements_left > 0) AS owing FROM b""")
def balance_totals(spark, sf):
    return B.totals(_b(spark, sf))


@query("settled_without_case", "J14", f"""
SELECT DISTINCT p AS party, {person_sql('p')} AS name FROM (SELECT CASE WHEN user_id % 7 = 0 THEN user_id + 1000000 ELSE user_id END AS p FROM events WHERE value > 50 AND event_type IN ('purchase', 'signup'))
WHERE p NOT IN (SELECT o_custkey FROM orders)""")
def settled_without_case(spark, sf):
    """Settled for, without any case at all; every seventh party's settlements stand under a name that no case has."""
    stranger = F.when(F.col("party") % 7 == 0, F.col("party") + 1_000_000).otherwise(F.col("party"))
    settled = settled_events(spark, sf).withColumn("party", stranger).withColumn("name", person(F.col("party")))
    return B.unmatched(B.balances(assessments(spark, sf), settled))


@query("balance_ranking", "O4", _balances_cte() + f"""
SELECT party, {person_sql('party')} AS name, tours_left + confinements_left AS total_left FROM b
WHERE tours_left + confinements_left > 0 ORDER BY 3 DESC, 2""")
def balance_ranking(spark, sf):
    b = R.rank_balances(_b(spark, sf))
    return b.select("party", "name", (F.col("tours_left") + F.col("confinements_left")).alias("total_left"))


@query("balance_kpis", "A16", _balances_cte() + """
SELECT count(*) AS parties, CAST(sum(forms) AS BIGINT) AS reports, sum(tours_left) AS remaining_tours,
  sum(confinements_left) AS remaining_confinements,
  count(*) FILTER (WHERE tours_left + confinements_left > 0) AS outstanding FROM b""")
def balance_kpis(spark, sf):
    return B.balance_kpis(_b(spark, sf))


def _allocation_sql() -> str:
    return f"""WITH li AS (
  SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS n_r,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS n_a FROM lineitem GROUP BY 1),
x AS (
  SELECT o_custkey AS party, o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS date_iso, coalesce(n_r, 0) AS n_r, coalesce(n_a, 0) AS n_a
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '3-MEDIUM'),
a AS (
  SELECT party, 'tour' AS kind, case_id, date_iso, n_r AS amount FROM x
  UNION ALL SELECT party, 'confinement', case_id, date_iso, n_a FROM x),
s AS (
  SELECT user_id AS party, CASE WHEN event_type = 'purchase' THEN 'tour' ELSE 'confinement' END AS kind, count(*) AS served
  FROM events WHERE value > 50 AND event_type IN ('purchase', 'signup') GROUP BY 1, 2),
w AS (
  SELECT a.*, coalesce(served, 0) AS served,
    sum(amount) OVER (PARTITION BY a.party, a.kind ORDER BY date_iso, case_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM a LEFT JOIN s ON s.party = a.party AND s.kind = a.kind)
SELECT party, kind, case_id, date_iso, amount, CAST(least(amount, greatest(0, cum - served)) AS DOUBLE) AS "left" FROM w"""


@query("oldest_first_allocation", "W2", _allocation_sql())
def oldest_first(spark, sf):
    a = assessments(spark, sf).where("counted and pos_neg <> 'Pos'")
    kinds = F.array(
        F.struct(F.lit("tour").alias("kind"), F.col("tours").alias("amount")),
        F.struct(F.lit("confinement").alias("kind"), F.col("confinements").alias("amount")),
    )
    long = a.select("party", "case_id", "date_iso", F.inline(kinds))
    return B.allocate_oldest_first(long, settled_events(spark, sf))


# ---- the settlement log ---------------------------------------------------------------------------------

def settlement_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Events written down by hand: one sheet per event type, headings in two layouts."""
    e = table(spark, sf, "events")
    t, v = F.col("event_type"), F.col("value")
    g, f = given(F.col("user_id")), family(F.col("user_id"))
    day = (
        F.when(t == "click", F.datediff(F.col("ts").cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
        .when(t == "view", F.date_format("ts", "d MMM yy")).when(t == "error", F.date_format("ts", "MM/dd/yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    name = (
        F.when(v < 2, "").when(t == "view", F.concat_ws(", ", f, g)).when(t == "error", F.concat_ws(" ", F.lit("C2C"), g, f))
        .when(t == "signup", F.concat_ws(" ", g, F.substr(f, F.lit(1), F.length(f) - 1)))
        .when(t == "purchase", F.concat_ws(" ", g, F.concat(f, F.lit("s")))).otherwise(F.concat_ws(" ", g, f))
    )
    kind = F.when(v < 20, "Tour").when(v < 60, "confinement (weekend)").when(v < 70, "Tour/Confinement").otherwise("Essay")
    k = F.regexp_extract("props", r"(\d+)", 1)
    amount = F.when(v < 4, "none").when(t == "view", F.concat(k, F.lit(" h"))).otherwise(k)
    body = e.select(
        t.alias("sheet"), (F.col("event_id") + 10).alias("row_no"),
        F.when(t == "purchase", F.array(amount, kind, name, day, F.lit("x")))
        .otherwise(F.array(day, name, kind, amount, F.lit("Sgt"), k)).alias("cells"),
    )
    heads = e.select("event_type").distinct().select(
        F.col("event_type").alias("sheet"), F.when(F.col("event_type") == "error", 3).otherwise(9).cast("bigint").alias("row_no"),
        F.when(F.col("event_type") == "purchase", F.array(*map(F.lit, ["amount served", "SANCTION-TYPE", "Cadet  Name", "Date Served"])))
        .otherwise(F.array(*map(F.lit, ["Date Served", "Cadet Name", "Sanction Type", "Amount Served", "Supervisor / Monitor", "Notes"]))).alias("cells"),
    )
    return body.unionByName(heads)


_NAME = f"""CASE WHEN value < 2 THEN ''
    WHEN event_type = 'view' THEN {family_sql('user_id')} || ', ' || {given_sql('user_id')}
    WHEN event_type = 'error' THEN 'C2C ' || {person_sql('user_id')}
    WHEN event_type = 'signup' THEN {given_sql('user_id')} || ' ' || substr({family_sql('user_id')}, 1, length({family_sql('user_id')}) - 1)
    WHEN event_type = 'purchase' THEN {person_sql('user_id')} || 's' ELSE {person_sql('user_id')} END"""

_LOG = f"""log AS (
  SELECT event_type AS sheet, event_id + 10 AS row_no, CAST(ts AS DATE) AS settled_on, {_NAME} AS cadet,
    CASE WHEN value < 20 OR value >= 60 AND value < 70 THEN 'tour' WHEN value < 60 THEN 'confinement' END AS kind,
    CASE WHEN value < 4 THEN 0 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS units, user_id FROM events),
skips AS (
  SELECT *, CASE WHEN cadet = '' THEN 'unnamed' WHEN kind IS NULL THEN 'unknown_type' WHEN NOT units > 0 THEN 'bad_amount' END AS skip_reason
  FROM log)
"""


@query("settlement_log", "S5", f"WITH {_LOG} SELECT sheet, row_no, settled_on, cadet, kind, units, skip_reason FROM skips")
def settlement_log(spark, sf):
    rows = B.read_settlements(settlement_cells(spark, sf))
    return rows.select("sheet", "row_no", "settled_on", "cadet", "kind", "units", "skip_reason")


@query("settlement_skips", "A19", f"WITH {_LOG} SELECT skip_reason, count(*) AS n FROM skips WHERE skip_reason IS NOT NULL GROUP BY 1")
def settlement_skips(spark, sf):
    return B.skip_counts(B.read_settlements(settlement_cells(spark, sf)))


@query("settlement_kpis", "A15", """
SELECT coalesce(sum(k) FILTER (WHERE value < 20 OR value >= 60 AND value < 70), 0) AS tours_served,
  coalesce(sum(k) FILTER (WHERE value >= 20 AND value < 70), 0) AS confinements_served, count(k) AS sessions
FROM (SELECT value, CASE WHEN value >= 4 AND event_type <> 'view' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS k FROM events)""")
def settlement_kpis(spark, sf):
    return B.settlement_kpis(B.read_settlements(settlement_cells(spark, sf)))


@query("recent_settlements", "W5", f"""WITH {_LOG}
SELECT sheet, row_no, settled_on, cadet FROM skips WHERE skip_reason IS NULL
QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY settled_on DESC, row_no DESC) <= 40""")
def recent_settlements(spark, sf):
    rows = B.read_settlements(settlement_cells(spark, sf)).where("skip_reason is null")
    last = R.keep_last(rows, ["sheet"], [F.desc("settled_on"), F.desc("row_no")], V.RECENT_KEEP)
    return last.select("sheet", "row_no", "settled_on", "cadet")


# Distance between two written names that both have a given and a family word.
def _distance_sql(ag: str, af: str, comma: str, bg: str, bf: str) -> str:
    def tok(a, b):
        return (f"(CASE WHEN {a} = {b} THEN 0 WHEN levenshtein({a}, {b}) <= least(2, least(length({a}), length({b})) // 3) "
                f"THEN levenshtein({a}, {b}) ELSE 3 END)")

    straight = f"({tok(af, bf)} + {tok(ag, bg)})"
    crossed = f"({tok(af, bg)} + {tok(ag, bf)})"
    return f"(CASE WHEN least({straight}, {crossed}) <= 2 THEN least({straight}, {crossed}) ELSE 3 END)"


_MATCHED = f"""
written AS (
  SELECT DISTINCT cadet, event_type, lower({given_sql('user_id')}) AS g,
    lower(CASE WHEN event_type = 'signup' THEN substr({family_sql('user_id')}, 1, length({family_sql('user_id')}) - 1)
      WHEN event_type = 'purchase' THEN {family_sql('user_id')} || 's' ELSE {family_sql('user_id')} END) AS f
  FROM (SELECT skips.*, sheet AS event_type FROM skips) WHERE cadet <> ''),
known AS (SELECT key, min_by(name, ord) AS name, split_part(lower(min_by(name, ord)), ' ', 1) AS g, split_part(lower(min_by(name, ord)), ' ', 2) AS f
  FROM case_parties GROUP BY key),
keyed AS (SELECT *, least(g, f) || ' ' || greatest(g, f) AS own FROM written),
near AS (
  SELECT w.cadet, k.key, {_distance_sql('w.g', 'w.f', 'false', 'k.g', 'k.f')} AS dist
  FROM keyed w, known k WHERE w.own NOT IN (SELECT key FROM known)),
best AS (
  SELECT cadet, min_by(key, dist) AS key FROM near n WHERE dist <= 2
    AND dist = (SELECT min(dist) FROM near m WHERE m.cadet = n.cadet) GROUP BY cadet HAVING count(*) = 1),
resolved AS (SELECT w.cadet, coalesce(b.key, w.own) AS key FROM keyed w LEFT JOIN best b ON b.cadet = w.cadet)
"""


def log_parties(spark: SparkSession, sf: str) -> DataFrame:
    """The parties of the cases (key, name, ord), one row a spelling: names are keyed once, not once a case."""
    once = case_names(spark, sf).groupBy("name").agg(F.min("ord").alias("ord"))
    return once.select(name_key("name").alias("key"), "name", "ord")


def log_resolved(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """The party of each name of the log's rows."""
    return resolve_parties(rows.where("cadet <> ''").select(F.col("cadet").alias("name")), log_parties(spark, sf))


@query("settlement_parties", "J3", with_cases("SELECT cadet AS name, key FROM resolved", True, _LOG + "," + _MATCHED))
def settlement_parties(spark, sf):
    return log_resolved(spark, sf, B.read_settlements(settlement_cells(spark, sf))).select("name", "key")


@query("balances_by_name", "A1, J3", with_cases("""
SELECT coalesce(a.key, s.key) AS party, a.key IS NOT NULL AS on_file, coalesce(forms, 0) AS forms,
  coalesce(ta, 0) AS tours_assigned, coalesce(ts, 0) AS tours_served, greatest(0, coalesce(ta, 0) - coalesce(ts, 0)) AS tours_left,
  coalesce(ca, 0) AS confinements_assigned, coalesce(cs, 0) AS confinements_served,
  greatest(0, coalesce(ca, 0) - coalesce(cs, 0)) AS confinements_left
FROM (SELECT key, count(*) AS forms, CAST(sum(CASE WHEN counted AND pos_neg <> 'Pos' THEN tours_n ELSE 0 END) AS DOUBLE) AS ta,
        CAST(sum(CASE WHEN counted AND pos_neg <> 'Pos' THEN confinements_n ELSE 0 END) AS DOUBLE) AS ca FROM case_parties GROUP BY key) a
FULL OUTER JOIN (SELECT r.key, coalesce(sum(units) FILTER (WHERE kind = 'tour'), 0) AS ts, coalesce(sum(units) FILTER (WHERE kind = 'confinement'), 0) AS cs
        FROM skips JOIN resolved r ON r.cadet = skips.cadet WHERE skip_reason IS NULL GROUP BY r.key) s ON a.key = s.key""",
    True, _LOG + "," + _MATCHED))
def balances_by_name(spark, sf):
    log = B.read_settlements(settlement_cells(spark, sf)).where("cadet <> ''")
    rows = cut_lineage(log.select("cadet", "kind", "units", "skip_reason"), "log")  # read twice
    who = log_resolved(spark, sf, rows)
    settled = rows.where("skip_reason is null").join(who.select(F.col("name").alias("cadet"), "key"), "cadet").select(
        F.col("key").alias("party"), F.col("cadet").alias("name"), "kind", "units"
    )
    from ..functions import num

    a = case_parties(spark, sf).select(
        F.col("key").alias("party"), "name", "ord", "class_year", "counted", "pos_neg", "date_iso",
        num("tours").alias("tours"), num("confinements").alias("confinements"),
    )
    return B.balances(a, settled).select(
        "party", "on_file", "forms", *[f"{k}_{w}" for k in B.KINDS for w in ("assigned", "served", "left")]
    )


@query("settlement_passthrough", "S12", with_cases("""
SELECT l.sheet, l.row_no, coalesce(k.name, l.cadet) AS cadet FROM skips l
LEFT JOIN resolved r ON r.cadet = l.cadet LEFT JOIN known k ON k.key = r.key""", True, _LOG + "," + _MATCHED))
def settlement_passthrough(spark, sf):
    raw = cut_lineage(B.read_settlements(settlement_cells(spark, sf)).select("sheet", "row_no", "cadet"), "log")  # read twice
    who = log_resolved(spark, sf, raw)
    parties = log_parties(spark, sf).groupBy("key").agg(F.min_by("name", "ord").alias("canonical"))
    spelling = who.join(parties, "key").select(F.col("name").alias("cadet"), "canonical")
    return B.passthrough(raw, spelling).select("sheet", "row_no", "cadet")


@query("reports_per_party", "A17", with_cases("SELECT key AS party, count(*) AS reports FROM case_parties GROUP BY key", True))
def reports_per_party(spark, sf):
    return B.reports_per_party(case_parties(spark, sf), "key")


@query("cutoff_presets", "F30", """
SELECT d AS days, count(*) AS n FROM (SELECT unnest([7, 14, 30, 60, 90]) AS d),
  (SELECT CAST(o_orderdate AS DATE) AS day, max(CAST(o_orderdate AS DATE)) OVER () AS today FROM orders)
WHERE day < today - CAST(d AS INTEGER) GROUP BY d""")
def cutoff_presets(spark, sf):
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf, "orders").select(day.alias("day"))
    today = o.agg(F.max("day").alias("today"), F.lit(1).alias("one"))
    before = o.withColumn("one", F.lit(1)).join(F.broadcast(today), "one")  # one row
    one = before.agg(*[F.count_if(F.col("day") < days_ago("today", d)).alias(str(d)) for d in V.CUTOFF_PRESETS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"`{d}`").alias("n")) for d in V.CUTOFF_PRESETS])))
