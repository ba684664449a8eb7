"""The driver tables read as case-tracking data, and the same reading written as SQL for the oracle.

A case is an order with its lines; a party is a customer; step flags, counts and lifecycle flags are
conditions on order and line columns. Names are spelled from keys, so every scale has as many as it has keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import name_key
from ..operators.records import complete, missing_manual

DIGITS, LETTERS = "0123456789", "aeoublnrts"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- names from keys ----------------------------------------------------------------------------------

def _spelled(n: Column) -> Column:
    return F.initcap(F.translate(n.cast("string"), DIGITS, LETTERS))


def given(k: Column) -> Column:
    return _spelled(F.lit(100) + (k * 31) % 900)


def family(k: Column) -> Column:
    return _spelled(F.lit(1000000) + (k * 7919) % 8999993)


def person(k: Column) -> Column:
    return F.concat_ws(" ", given(k), family(k))


def person_text(k: str) -> str:
    """`person` as Spark SQL text."""
    word = lambda n: f"initcap(translate(string({n}), '{DIGITS}', '{LETTERS}'))"
    return f"concat_ws(' ', {word(f'100 + ({k} * 31) % 900')}, {word(f'1000000 + ({k} * 7919) % 8999993')})"


def _spelled_sql(n: str) -> str:
    t = f"translate(CAST({n} AS VARCHAR), '{DIGITS}', '{LETTERS}')"
    return f"(upper(substr({t}, 1, 1)) || substr({t}, 2))"


def given_sql(k: str) -> str:
    return _spelled_sql(f"(100 + ({k} * 31) % 900)")


def family_sql(k: str) -> str:
    return _spelled_sql(f"(1000000 + ({k} * 7919) % 8999993)")


def person_sql(k: str) -> str:
    return f"({given_sql(k)} || ' ' || {family_sql(k)})"


def key_sql(k: str) -> str:
    """Name key of a spelled person: its two words, lower case, sorted."""
    g, f = f"lower({given_sql(k)})", f"lower({family_sql(k)})"
    return f"(least({g}, {f}) || ' ' || greatest({g}, {f}))"


# ---- cases ----------------------------------------------------------------------------------------------

def lines_per_case(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count("*").alias("n_lines"), F.expr("count_if(l_returnflag = 'R')").alias("n_r"),
        F.expr("count_if(l_returnflag = 'A')").alias("n_a"), F.expr("count_if(l_linestatus = 'F')").alias("n_f"),
    )


_BASE = [
    "case_id", "o_custkey AS party_id", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "c_nationkey",
    "c_mktsegment", "c_acctbal", *[f"coalesce({c}, 0L) AS {c}" for c in ("n_lines", "n_r", "n_a", "n_f")],
]
_FACTS = [
    "*", "if(c_mktsegment = 'BUILDING', 'F174', 'F10') AS form_type",
    "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'Pos' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'Neg' END AS pos_neg",
    "if(o_orderpriority = '4-NOT SPECIFIED', '', concat_ws(' ', c_mktsegment, substr(o_orderpriority, 3))) AS reason_category",
    f"{person_text('party_id')} AS recipients", "if(o_totalprice >= 20000, cast(o_orderdate AS date), NULL) AS date_iso",
    "n_f > 0 AS issuer_signed", "if(c_mktsegment <> 'BUILDING', o_orderstatus <> 'O', NULL) AS sqccf_processed",
    "if(c_mktsegment <> 'BUILDING', o_totalprice > 100000, NULL) AS cadet_cc_initialed",
    "o_orderstatus = 'F' OR n_r > 1 AS recipient_signed", "o_orderstatus = 'F' AS aoc_signed",
    "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS rejected",
    "o_orderdate < TIMESTAMP_NTZ '1995-07-01 00:00:00' AS archived", "o_totalprice > 490000 AS missing", "n_lines > 0 AS parsed",
    "o_orderdate < TIMESTAMP_NTZ '1999-01-01 00:00:00' AS logged", "n_a > 1 AS reviewed",
]
_FIELDS = [
    "*",
    "concat(concat_ws('_', recipients, pos_neg, form_type, replace(reason_category, ' ', ''), case_id), '.pdf') AS filename",
    f"if(o_orderpriority = '2-HIGH', array(recipients, {person_text('(party_id + 1)')}), array(recipients)) AS recipient_list",
    "concat('lines ', n_lines) AS reason_details", f"{person_text('(c_nationkey + 500)')} AS issuer",
    "if(c_acctbal < 500, '', concat('20', 24 + c_nationkey % 5)) AS class_year", "concat('SQ', c_nationkey) AS squadron",
    "if(form_type = 'F10', string(n_a), '') AS demerits", "if(form_type = 'F10', concat(n_r, ' tours'), '') AS tours",
    "if(form_type = 'F10', string(n_lines - n_r - n_a), '') AS confinements",
    "if(form_type = 'F10' AND pos_neg = 'Pos' AND n_f > 0, '3', '') AS cdna",
    "if(form_type = 'F10' AND pos_neg = 'Pos' AND n_lines > 3, '2', '') AS passes",
    "if(n_lines > 6, 'POV revoked: 1 week', '') AS other", "lower(o_orderpriority) AS notes", "n_lines AS page_count",
    "pos_neg = '' OR n_lines > 6 AS flagged",
]


def case_facts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "case_id")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    j = o.join(lines_per_case(spark, sf), "case_id", "left").join(c, o["o_custkey"] == c["c_custkey"])
    return j.selectExpr(*_BASE).selectExpr(*_FACTS).selectExpr(*_FIELDS)


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One record per order."""
    j = case_facts(spark, sf).withColumns({
        "complete": complete([F.col(s) for s in V.STEPS]),
        "incomplete": F.when(
            F.expr("parsed AND NOT archived AND NOT rejected AND NOT missing"),
            missing_manual(F.col("form_type"), F.col("pos_neg"), {"cdna": F.col("cdna"), "passes": F.col("passes")}),
        ).otherwise(F.expr("cast(array() AS array<string>)")),
        "party_keys": F.transform("recipient_list", name_key),
    })
    return j.selectExpr(
        "*", "complete AND NOT rejected AND NOT archived AS counted",
        "flagged AND NOT reviewed AND NOT archived AND NOT rejected AS needs_review",
    )


_FIRST_OPEN = """CASE WHEN rejected THEN 'rejected' WHEN NOT parsed THEN NULL
  WHEN issuer_signed = false THEN 'issuer_signed' WHEN sqccf_processed = false THEN 'sqccf_processed'
  WHEN cadet_cc_initialed = false THEN 'cadet_cc_initialed' WHEN recipient_signed = false THEN 'recipient_signed'
  WHEN aoc_signed = false THEN 'aoc_signed' ELSE 'complete' END"""

CASES = f"""
li AS (
  SELECT l_orderkey AS case_id, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r,
    count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f
  FROM lineitem GROUP BY 1),
c0 AS (
  SELECT o_orderkey AS case_id, o_custkey AS party_id, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate,
    c_nationkey, c_mktsegment, c_acctbal, coalesce(n_lines, 0) AS n_lines, coalesce(n_r, 0) AS n_r,
    coalesce(n_a, 0) AS n_a, coalesce(n_f, 0) AS n_f
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON li.case_id = o_orderkey),
c1 AS (
  SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'F174' ELSE 'F10' END AS form_type,
    CASE o_orderpriority WHEN '3-MEDIUM' THEN 'Pos' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'Neg' END AS pos_neg,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE c_mktsegment || ' ' || substr(o_orderpriority, 3) END AS reason_category,
    {person_sql('party_id')} AS recipients,
    CASE WHEN o_totalprice >= 20000 THEN CAST(o_orderdate AS DATE) END AS date_iso,
    n_f > 0 AS issuer_signed,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN o_orderstatus <> 'O' END AS sqccf_processed,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN o_totalprice > 100000 END AS cadet_cc_initialed,
    (o_orderstatus = 'F' OR n_r > 1) AS recipient_signed, o_orderstatus = 'F' AS aoc_signed,
    (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS rejected,
    o_orderdate < TIMESTAMP '1995-07-01' AS archived, o_totalprice > 490000 AS missing, n_lines > 0 AS parsed
  FROM c0),
c2 AS (
  SELECT *,
    recipients || '_' || pos_neg || '_' || form_type || '_' || replace(reason_category, ' ', '') || '_' || case_id || '.pdf' AS filename,
    CASE WHEN o_orderpriority = '2-HIGH' THEN [recipients, {person_sql('(party_id + 1)')}] ELSE [recipients] END AS recipient_list,
    CASE WHEN o_orderpriority = '2-HIGH' THEN [{key_sql('party_id')}, {key_sql('(party_id + 1)')}] ELSE [{key_sql('party_id')}] END AS party_keys,
    'lines ' || n_lines AS reason_details, {person_sql('(c_nationkey + 500)')} AS issuer,
    CASE WHEN c_acctbal < 500 THEN '' ELSE '20' || (24 + c_nationkey % 5) END AS class_year,
    'SQ' || c_nationkey AS squadron,
    CASE WHEN form_type = 'F10' THEN n_a ELSE 0 END AS demerits_n,
    CASE WHEN form_type = 'F10' THEN n_r ELSE 0 END AS tours_n,
    CASE WHEN form_type = 'F10' THEN n_lines - n_r - n_a ELSE 0 END AS confinements_n,
    CASE WHEN form_type = 'F10' AND pos_neg = 'Pos' AND n_f > 0 THEN '3' ELSE '' END AS cdna,
    CASE WHEN form_type = 'F10' AND pos_neg = 'Pos' AND n_lines > 3 THEN '2' ELSE '' END AS passes,
    CASE WHEN n_lines > 6 THEN 'POV revoked: 1 week' ELSE '' END AS other, lower(o_orderpriority) AS notes,
    o_orderdate < TIMESTAMP '1999-01-01' AS logged, n_a > 1 AS reviewed, (pos_neg = '' OR n_lines > 6) AS flagged,
    ((issuer_signed OR coalesce(sqccf_processed, false) OR coalesce(cadet_cc_initialed, false) OR recipient_signed OR aoc_signed)
     AND issuer_signed AND coalesce(sqccf_processed, true) AND coalesce(cadet_cc_initialed, true) AND recipient_signed AND aoc_signed) AS complete,
    (issuer_signed = false OR coalesce(sqccf_processed, true) = false OR coalesce(cadet_cc_initialed, true) = false
     OR recipient_signed = false OR aoc_signed = false) AS waiting
  FROM c1),
cases AS (
  SELECT *, complete AND NOT rejected AND NOT archived AS counted,
    flagged AND NOT reviewed AND NOT archived AND NOT rejected AS needs_review,
    CASE WHEN parsed AND NOT archived AND NOT rejected AND NOT missing AND form_type = 'F10' AND pos_neg = 'Pos'
      THEN CASE WHEN cdna = '' THEN 1 ELSE 0 END + CASE WHEN passes = '' THEN 1 ELSE 0 END ELSE 0 END AS n_incomplete,
    NOT missing AND NOT archived AND NOT rejected AS is_active, NOT missing AND NOT archived AND NOT rejected AND parsed AS is_parsed,
    {_FIRST_OPEN} AS first_open
  FROM c2)
"""


def case_parties(spark: SparkSession, sf: str) -> DataFrame:
    """One row per case and party (key, name, ord), for cases that are read, present and not archived."""
    c = cases(spark, sf).where("NOT missing AND NOT archived AND parsed").selectExpr("*", "posexplode(recipient_list) AS (pos, name)")
    return c.selectExpr("*", "party_keys[pos] AS key", "case_id * 10 + pos AS ord")


def case_names(spark: SparkSession, sf: str) -> DataFrame:
    """Name and place (name, ord) of the rows of `case_parties`."""
    c = case_facts(spark, sf).where("NOT missing AND NOT archived AND parsed").selectExpr("case_id", "posexplode(recipient_list) AS (pos, name)")
    return c.selectExpr("name", "case_id * 10 + pos AS ord")


PARTIES = """
case_parties AS (
  SELECT c.*, unnest(recipient_list) AS name, unnest(party_keys) AS key, unnest(range(len(recipient_list))) AS pos,
    case_id * 10 + unnest(range(len(recipient_list))) AS ord
  FROM cases c WHERE NOT missing AND NOT archived AND parsed)
"""


def with_cases(select: str, parties: bool = False, extra: str = "") -> str:
    parts = [CASES.strip()] + ([PARTIES.strip()] if parties else []) + ([extra.strip()] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + select
