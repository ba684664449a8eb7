"""Column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as C
from ..operators.scale import spread
from .bindings import family, family_sql, given, given_sql, key_sql, person, person_sql, table
from .registry import query


def _k():
    return F.col("c_custkey")


@query("collapse_text", "F1", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")
def collapse_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.collapse("text").alias("clean"))


@query("split_camel", "F3", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '[-\s]+', ' ', 'g')) AS words
FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', p_type) || '-' || p_brand AS w FROM part)""")
def split_camel(spark, sf):
    w = F.expr("concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', p_type), '-', p_brand)")
    return table(spark, sf, "part").select("p_partkey", C.split_camel(w).alias("words"))


@query("parsed_filenames", "F2", f"""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {person_sql('o_custkey')} WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'scan' || o_orderkey END AS recipient,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Neg' WHEN '2-HIGH' THEN 'Pos' WHEN '3-MEDIUM' THEN 'Neg' ELSE '' END AS pos_neg,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'F10' WHEN '2-HIGH' THEN 'F174' WHEN '3-MEDIUM' THEN 'F10' WHEN '4-NOT SPECIFIED' THEN 'F10' ELSE '' END AS form_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Late Work' WHEN '2-HIGH' THEN 'Service' WHEN '3-MEDIUM' THEN 'Late' ELSE '' END AS reason,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS valid,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN 'no recipient part' WHEN '4-NOT SPECIFIED' THEN 'no Pos/Neg part|no reason part'
    WHEN '5-LOW' THEN 'no Pos/Neg part|no form type part (F10 / F174)|no recipient part' ELSE '' END AS problems
FROM orders""".replace("WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE", "WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN '' ELSE"))
def parsed_filenames(spark, sf):
    who = person(F.col("o_custkey"))
    key = F.col("o_orderkey").cast("string")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(who, F.lit("_Neg_F10_LateWork.pdf")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(who, F.lit("_positive_AF Form-174_Service.PDF")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Neg_F10_Late.pdf"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("scan"), key, F.lit("_f10.pdf")))
        .otherwise(F.concat(F.lit("scan"), key, F.lit(".pdf")))
    )
    p = table(spark, sf, "orders").select("o_orderkey", C.parse_filename(name).alias("p"))
    return p.select("o_orderkey", *[f"p.{c}" for c in ("recipient", "pos_neg", "form_type", "reason", "valid")], F.array_join("p.problems", "|").alias("problems"))


@query("stripped_ranks", "F4, F6", f"SELECT c_custkey, {person_sql('c_custkey')} AS name, {family_sql('c_custkey')} || ', ' || {given_sql('c_custkey')} AS bare FROM customer")
def stripped_ranks(spark, sf):
    written = (
        F.when(F.col("c_nationkey") < 5, F.concat_ws(" ", F.lit("C/2d Lt"), F.concat(family(_k()), F.lit(",")), given(_k())))
        .when(F.col("c_nationkey") < 10, F.concat_ws(" ", F.concat(F.lit("C3C "), family(_k()), F.lit(",")), F.lit("Cadet"), given(_k())))
        .otherwise(F.concat_ws(" ", F.lit("C/Capt"), F.concat(family(_k()), F.lit(",")), given(_k())))
    )
    return table(spark, sf, "customer").select("c_custkey", C.single_name(written).alias("name"), C.strip_rank(written).alias("bare"))


@query("split_name_lists", "F5", f"""
SELECT o_orderkey, {person_sql('o_custkey')} || '|' || {person_sql('(o_custkey + 1)')} || CASE WHEN o_orderstatus = 'F' THEN '|' || {given_sql('o_custkey')} ELSE '' END AS people FROM orders""")
def split_name_lists(spark, sf):
    k = F.col("o_custkey")
    typed = F.concat(
        F.lit("C4C "), family(k), F.lit(", "), given(k), F.lit("; "), person(k + 1),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(",\n"), given(k))).otherwise(" "),
    )
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(C.split_names(typed), "|").alias("people"))


@query("name_keys", "F7", f"SELECT c_custkey, {key_sql('c_custkey')} AS key, {key_sql('c_custkey')} AS swapped FROM customer")
def name_keys(spark, sf):
    other = F.concat(F.lit("C2C "), family(_k()), F.lit(", "), given(_k()), F.lit(" Q."))
    return table(spark, sf, "customer").select("c_custkey", C.name_key(person(_k())).alias("key"), C.name_key(other).alias("swapped"))


@query("capped_edit_distance", "F8", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(levenshtein(p_name, s_name), 3) AS edits, least(levenshtein(p_name, p_brand || p_type), 3) AS other
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_partkey AS k, p_name AS s_name FROM part) ON k = l_suppkey""")
def capped_edit_distance(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s_name"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("k"))
    capped = lambda a, b: F.when(F.levenshtein(a, b, 2) >= 0, F.levenshtein(a, b, 2)).otherwise(3)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", capped(F.col("p_name"), F.col("s_name")).alias("edits"),
                    capped(F.col("p_name"), F.concat("p_brand", "p_type")).alias("other"))


@query("parsed_dates", "F9", """
SELECT o_orderkey, d AS a, d AS b, d AS c, d, d AS e, CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS f, CAST(NULL AS DATE) AS g,
  CASE WHEN year(d) - 6 < 2000 THEN CASE WHEN month(d) = 2 AND strftime(d0, '%d') = '29' THEN DATE '2096-02-29' ELSE CAST(d0 + INTERVAL 100 YEAR AS DATE) END ELSE d0 END AS h, CAST(NULL AS DATE) AS i
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate + INTERVAL 6 YEAR AS DATE) AS d FROM orders)""")
def parsed_dates(spark, sf):
    o = spread(table(spark, sf, "orders"), "o_orderkey").withColumn("day", F.add_months(F.col("o_orderdate").cast("date"), 72))
    text = lambda fmt: F.date_format("day", fmt)
    early = F.col("o_orderdate")
    shapes = {"a": text("d MMM yy"), "b": F.upper(text("ddMMMyyyy")), "c": F.concat(F.lit("on "), text("yyyy.M.d")), "d": text("MMMM d, yyyy"),
              "e": text("yyyyMMdd"), "f": text("dd/MM/yyyy"), "g": F.concat(text("d"), F.lit(" Foo "), text("yyyy")),
              "h": F.date_format(early, "MM/dd/yy"), "i": F.concat(F.lit("1900-"), F.date_format(early, "MM-dd"))}
    return o.select("o_orderkey", *[C.parse_date(v).alias(k) for k, v in shapes.items()])


@query("parsed_years", "F10", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) < 2000 THEN 'Class of ' || year(o_orderdate) WHEN o_orderpriority = '1-URGENT' THEN CAST(year(o_orderdate) AS VARCHAR)
  ELSE '20' || strftime(o_orderdate, '%y') END AS class_year,
  CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN '20' || strftime(o_orderdate, '%y') END AS strict FROM orders""")
def parsed_years(spark, sf):
    pr, yy = F.col("o_orderpriority"), F.date_format("o_orderdate", "yy")
    raw = (F.when(pr == "5-LOW", "unknown").when(pr == "1-URGENT", F.concat(F.lit("Class of "), F.date_format("o_orderdate", "yyyy")))
           .when(pr == "2-HIGH", F.concat(F.lit("'"), yy)).when(pr == "3-MEDIUM", F.concat(F.lit("C "), yy)).otherwise(yy))
    return table(spark, sf, "orders").select("o_orderkey", C.parse_class_year(raw).alias("class_year"), C.norm_year(raw).alias("strict"))


@query("stripped_labels", "F11, F12, F13", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'R' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 'A' THEN 'N/A' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' weekends' END AS bare,
  CASE l_returnflag WHEN 'A' THEN '0' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS count,
  CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' weekends' END AS other FROM lineitem""")
def stripped_labels(spark, sf):
    n = F.col("l_quantity").cast("int").cast("string")
    raw = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("4. TOURS  "), n, F.lit(" tours")))
           .when(F.col("l_returnflag") == "A", F.lit("1. Demerit(s) N/A")).otherwise(F.concat(F.lit("3. LOSS OF PASS PRIV "), n, F.lit(" weekends"))))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(*keys, raw.alias("raw"))
    bare = F.col("bare")
    return lines.select(*keys, "raw", C.strip_label("raw").alias("bare")).select(
        *keys, "bare", C.sanction_count("raw", bare=bare).alias("count"), C.other_text("raw", bare).alias("other"))


@query("number_prefixes", "F15", "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS n FROM events")
def number_prefixes(spark, sf):
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(
        F.concat(F.lit(" "), F.format_string("%.2f", "value"), F.lit(" tours")))
    return table(spark, sf, "events").select("event_id", C.num(raw).alias("n"))


@query("name_forms", "F17, F18, F28", f"""
SELECT c_custkey, {given_sql('c_custkey')} AS first_name, {family_sql('c_custkey')} AS last_name,
  {given_sql('c_custkey')} || ' ' || {family_sql('c_custkey')} AS shown, 'Dear ' || {given_sql('c_custkey')} || ' ' || {family_sql('c_custkey')} || ' $1' AS letter,
  lower({given_sql('c_custkey')}) AS given_words, lower({family_sql('c_custkey')}) AS family, c_nationkey >= 12 AS comma FROM customer""")
def name_forms(spark, sf):
    raw = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("Mr. "), given(_k()), F.lit(" (Jack) "), family(_k()), F.lit(" Jr"))).otherwise(
        F.concat(F.upper(family(_k())), F.lit(", "), F.upper(given(_k()))))
    # few bytes, much work a row; a name is taken apart once
    named = spread(table(spark, sf, "customer").select("c_custkey", raw.alias("raw")), "c_custkey").withColumn("p", C.name_parts("raw"))
    p = F.col("p")
    named = named.withColumns({"first_name": C.first_name("raw", p), "last_name": C.last_name("raw", p)})
    return named.select(
        "c_custkey", "first_name", "last_name", C.display_name("raw", p).alias("shown"),
        C.fill_template(F.lit("Dear {First_Name} {lastname} $1"), F.col("raw"), F.col("first_name"), F.col("last_name")).alias("letter"),
        F.array_join(p["given"], " ").alias("given_words"), p["family"].alias("family"), p["comma"].alias("comma"))


_TOK = lambda a, b: f"(CASE WHEN {a} = {b} THEN 0 WHEN levenshtein({a}, {b}) <= least(2, least(length({a}), length({b})) // 3) THEN levenshtein({a}, {b}) ELSE 3 END)"


@query("name_distances", "F19", f"""
SELECT a, b, CASE WHEN least({_TOK('ga', 'gb')} + {_TOK('fa', 'fb')}, {_TOK('ga', 'fb')} + {_TOK('fa', 'gb')}) <= 2
  THEN least({_TOK('ga', 'gb')} + {_TOK('fa', 'fb')}, {_TOK('ga', 'fb')} + {_TOK('fa', 'gb')}) ELSE 3 END AS dist
FROM (SELECT DISTINCT x.p_name AS a, y.p_name AS b, split_part(x.p_name, ' ', 1) AS ga, split_part(x.p_name, ' ', 2) AS fa,
    split_part(y.p_name, ' ', 1) AS gb, split_part(y.p_name, ' ', 2) AS fb
  FROM lineitem JOIN part x ON x.p_partkey = l_partkey JOIN part y ON y.p_partkey = l_suppkey)""")
def name_distances(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    a = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a"))
    b = p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b"))
    return li.join(a, "l_partkey").join(b, "l_suppkey").select("a", "b").distinct().select("a", "b", C.name_distance("a", "b").alias("dist"))


@query("normalised_headers", "F20", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages")
def normalised_headers(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.norm_text("url").alias("key"))


@query("filename_keys", "F21", r"""
SELECT o_orderkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(f, '(?i)\.pdf$', ''), '\(\d+\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')),
  '\b(copy|signed|sign|sig|final|updated|update|scan|scanned|new|returned|done|completed?|rev\d*|v\d+)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key
FROM (SELECT o_orderkey, 'Scan_' || o_orderpriority || ' (' || (o_custkey % 7) || ') rev' || (o_custkey % 5) || ' signed-Copy.PDF' AS f FROM orders)""")
def filename_keys(spark, sf):
    f = F.expr("concat('Scan_', o_orderpriority, ' (', o_custkey % 7, ') rev', o_custkey % 5, ' signed-Copy.PDF')")
    return table(spark, sf, "orders").select("o_orderkey", C.filename_key(f).alias("key"))




@query("short_dice", "F22", """
WITH v AS (SELECT p_partkey, p_name AS a, p_brand || ' ' || p_name AS b FROM part),
ga AS (SELECT p_partkey, substr(a, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(a))) AS i FROM v) GROUP BY ALL),
gb AS (SELECT p_partkey, substr(b, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(b))) AS i FROM v) GROUP BY ALL)
SELECT v.p_partkey, 2.0 * CAST(sum(least(ga.c, gb.c)) AS DOUBLE) / max(length(a) + length(b) - 2) AS dice
FROM v JOIN ga ON ga.p_partkey = v.p_partkey JOIN gb ON gb.p_partkey = v.p_partkey AND gb.g = ga.g GROUP BY v.p_partkey""")
def short_dice(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.dice("p_name", F.concat_ws(" ", "p_brand", "p_name")).alias("dice"))


@query("document_emails", "F23", r"""
SELECT doc_id, email, length(email) <= 254 AS ok FROM (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(text,
  '[A-Za-z0-9._%+''-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}')), '^[''.]+|[.'']+$', '', 'g')) AS email FROM documents)""")
def document_emails(spark, sf):
    from ..functions.text import clean_email

    d = table(spark, sf, "documents").select("doc_id", F.explode(C.emails_in("text")).alias("raw"))
    return d.select("doc_id", clean_email(F.col("raw")).alias("email")).select("doc_id", "email", C.is_email("email").alias("ok"))


@query("name_like_cells", "F25", f"""
SELECT c_custkey, CAST(CASE WHEN {given_sql('c_custkey')} = 'Dod' THEN 0 ELSE 4.5 END AS DOUBLE) AS full_name, CAST(2.5 AS DOUBLE) AS one_word,
  CAST(0 AS DOUBLE) AS number, CAST(0 AS DOUBLE) AS header, {person_sql('c_custkey')} AS from_address FROM customer""")
def name_like_cells(spark, sf):
    mail = F.concat(F.lower(given(_k())), F.lit("."), F.lower(family(_k())), _k().cast("string"), F.lit("@x.edu"))
    return spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(
        "c_custkey", C.name_likeness(person(_k())).alias("full_name"), C.name_likeness(family(_k())).alias("one_word"),
        C.name_likeness(F.concat(F.lit("555-"), _k().cast("string"))).alias("number"), C.name_likeness(F.lit("Email address")).alias("header"),
        C.name_from_address(mail).alias("from_address"))


@query("sheet_serials", "F26", "SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial, CAST(o_orderdate AS DATE) AS back FROM orders")
def sheet_serials(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", C.date_to_serial(d).alias("serial"),
                                             C.serial_to_date(C.date_to_serial(d).cast("string")).alias("back"))


@query("case_ids", "F27", "SELECT page_id, substr(sha1(lower(url)), 1, 14) AS id, sha1(html) AS content FROM pages")
def case_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.form_id("url").alias("id"), F.sha1("html").alias("content"))


@query("display_dates", "F29", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'No date' ELSE o_orderpriority END ELSE strftime(o_orderdate, '%-d %b %y') END AS shown FROM orders""")
def display_dates(spark, sf):
    d = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    raw = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", C.display_date(d, raw).alias("shown"))
