"""Fuzzy joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filename_key, norm_text
from ..operators import match as M
from ..operators.assignment import assign_widgets
from ..operators.scale import keep_first, spread
from ..session import cut_lineage
from .bindings import family_sql, given_sql, person, table
from .registry import query

# ---- near-duplicate spellings -----------------------------------------------------------------------

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_PLAIN = f"regexp_replace({_TITLE}, '[^ -~]', '?')"  # the SQL engine counts edits in bytes
_PLAIN_SQL = f"regexp_replace({_TITLE}, '[^ -~]', '?', 'g')"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Page titles, and the same as miswritten on a second copy."""
    t = table(spark, sf, "pages").select(F.expr(_PLAIN).alias("name")).where("name <> ''")
    slip = t.select(F.concat(F.substr("name", F.lit(1), F.lit(6)), F.substr("name", F.lit(8)), F.lit("s")).alias("name"))
    return t.unionByName(slip).groupBy("name").agg(F.count("*").alias("n"))


def _near_sql(names: str) -> str:
    return f"""WITH n AS ({names})
SELECT x.name AS a, y.name AS b, x.n AS a_n, y.n AS b_n, levenshtein(lower(x.name), lower(y.name)) AS edits FROM n x JOIN n y ON x.name < y.name
WHERE lower(x.name) <> lower(y.name) AND length(x.name) >= 4 AND length(y.name) >= 4 AND abs(length(x.name) - length(y.name)) <= 2
  AND levenshtein(lower(x.name), lower(y.name)) <= 2"""


@query("near_duplicate_names", "J4", _near_sql("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1")
       + " AND NOT (x.name = 'cold gear' AND y.name = 'old gear')")
def near_duplicate_names(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    ruled = table(spark, sf, "part").where("p_name = 'cold gear'").select(F.col("p_name").alias("b"), F.lit("Old Gear").alias("a")).distinct()
    return M.near_duplicate_names(names, distinct_pairs=ruled)


@query("near_duplicate_people", "J4", _near_sql(
    f"SELECT {given_sql('c_custkey')} || ' ' || {family_sql('c_custkey')} AS name, 1 AS n FROM customer UNION ALL "
    f"SELECT {given_sql('user_id')} || ' ' || {family_sql('user_id')} || 's', count(*) FROM events GROUP BY 1").replace("1 AS n", "count(*) AS n").replace("FROM customer UNION", "FROM customer GROUP BY 1 UNION"))
def near_duplicate_people(spark, sf):
    k, u = F.col("c_custkey"), F.col("user_id")
    a = table(spark, sf, "customer").groupBy(person(k).alias("name")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(person(u), F.lit("s")).alias("name"), "n")
    return M.near_duplicate_names(a.unionByName(b))


@query("near_duplicate_titles", "J4", _near_sql(
    f"SELECT name, count(*) AS n FROM (SELECT {_PLAIN_SQL} AS name FROM pages UNION ALL SELECT substr({_PLAIN_SQL}, 1, 6) || substr({_PLAIN_SQL}, 8) || 's' FROM pages WHERE {_PLAIN_SQL} <> '') WHERE name <> '' GROUP BY 1"))
def near_duplicate_titles(spark, sf):
    return M.near_duplicate_names(titles(spark, sf))


def _tok(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} = {b} THEN 0 WHEN levenshtein({a}, {b}) <= least(2, least(length({a}), length({b})) // 3) THEN levenshtein({a}, {b}) ELSE 3 END)")


def part_people(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two spellings of two-word names: part names with a brand suffix, and the same written family first."""
    p = table(spark, sf, "part")
    suffix = F.translate(F.substr("p_brand", F.lit(7)), "0123456789", "abcdefghkm")
    words = F.split("p_name", " ")
    left = p.where("p_type = 'ECONOMY'").select(F.concat(F.get(words, F.lit(1)), suffix, F.lit(", "), F.get(words, F.lit(0))).alias("name"))
    right = p.where("p_type <> 'ECONOMY'").select(F.concat_ws(" ", F.get(words, F.lit(0)), F.concat(F.get(words, F.lit(1)), suffix)).alias("name"), F.col("p_partkey").alias("ord"))
    return left, right


_PEOPLE = """
base AS (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) || translate(substr(p_brand, 7), '0123456789', 'abcdefghkm') AS f FROM part),
l AS (SELECT DISTINCT f || ', ' || g AS name, g, f FROM base WHERE p_type = 'ECONOMY'),
r AS (SELECT g || ' ' || f AS name, g, f, min(p_partkey) AS ord FROM base WHERE p_type <> 'ECONOMY' GROUP BY ALL)"""
_D = lambda x, y, rg, rf: f"least({_tok(x + '.g', y + '.' + rg)} + {_tok(x + '.f', y + '.' + rf)}, {_tok(x + '.g', y + '.' + rf)} + {_tok(x + '.f', y + '.' + rg)})"


@query("best_name_match", "J3, U4", f"""WITH {_PEOPLE},
d AS (SELECT l.name, r.name AS candidate, r.ord, r.g, r.f, {_D('l', 'r', 'g', 'f')} AS dist FROM l, r),
ok AS (SELECT * FROM d WHERE dist <= 2),
w AS (SELECT name, min(dist) AS dist FROM ok GROUP BY name),
win AS (SELECT ok.name, min_by(candidate, ord) AS match, min(ok.dist) AS dist, min_by(g, ord) AS g, min_by(f, ord) AS f FROM ok JOIN w ON w.name = ok.name AND w.dist = ok.dist GROUP BY ok.name)
SELECT win.name, match, win.dist, coalesce(bool_or({_D('win', 'o', 'g', 'f')} > 0) FILTER (WHERE o.candidate IS NOT NULL), false) AS ambiguous
FROM win LEFT JOIN ok o ON o.name = win.name AND o.dist = win.dist AND o.candidate <> win.match GROUP BY ALL""")
def best_name_match(spark, sf):
    return M.best_match(*part_people(spark, sf))


@query("canonical_names", "J2", """
SELECT p_partkey, CASE WHEN p_name LIKE 'cold %' THEN 'Cool' || substr(p_name, 5) ELSE p_name END AS name FROM part""")
def canonical_names(spark, sf):
    p = table(spark, sf, "part")
    aliases = p.where("p_name like 'cold %'").select(F.col("p_name").alias("name_lc"), F.concat(F.lit("Cool"), F.substr("p_name", F.lit(5))).alias("spelling")).distinct()
    written = p.select("p_partkey", F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  ")).alias("w"))
    return M.canonicalise(written, "w", aliases, "name").select("p_partkey", "name")


@query("connected_spellings", "J18", f"""WITH RECURSIVE e AS (
  SELECT DISTINCT lower(a) AS a, lower(b) AS b FROM ({_near_sql("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1")})),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y),
c AS (SELECT x AS name, min(y) AS root FROM r GROUP BY x)
SELECT c.name, c.root, d.spelling FROM c JOIN (SELECT k.root, max_by(b, a || '|' || b) AS spelling FROM e JOIN c k ON k.name = a GROUP BY 1) d ON d.root = c.root""")
def connected_spellings(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    near = M.near_duplicate_names(names).select("a", "b")
    answers = near.select("a", "b", F.col("b").alias("spelling"), F.concat_ws("|", "a", "b").alias("ord"))
    return M.connected_spellings(cut_lineage(answers))


# ---- bigram overlap and candidate documents -------------------------------------------------------------

PASSAGE_FLOOR = 0.6


@query("passage_dice", "U5", rf"""
WITH p AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s FROM benchmark),
gp AS (SELECT doc_id, substr(s, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(s))) AS i FROM p) GROUP BY ALL),
gb AS (SELECT item_id, substr(s, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(s))) AS i FROM b) GROUP BY ALL),
h AS (SELECT doc_id, item_id, CAST(sum(least(gp.c, gb.c)) AS DOUBLE) AS hit FROM gp JOIN gb USING (g) GROUP BY ALL)
SELECT doc_id AS a, item_id AS b, 2.0 * hit / (length(p.s) - 1 + length(b.s) - 1) AS dice FROM h JOIN p USING (doc_id) JOIN b USING (item_id)
WHERE 2.0 * hit / (length(p.s) - 1 + length(b.s) - 1) >= {PASSAGE_FLOOR}""")
def passage_dice(spark, sf):
    """Every pair of a document and a passage whose whole texts have a Dice of the floor or more, wherever they differ."""
    d = table(spark, sf, "documents").select("doc_id", norm_text("text").alias("s"))
    b = table(spark, sf, "benchmark").select("item_id", norm_text("text").alias("s"))
    near = M.similar_texts(d.withColumnRenamed("doc_id", "key"), b.withColumnRenamed("item_id", "key"), PASSAGE_FLOOR)
    return near.select(F.col("left").alias("a"), F.col("right").alias("b"), "dice")


FIELDS = {"recipient_name": 3.0, "reason": 2.0, "class_year": 0.5}
INDEXED = ["recipient_name", "reason"]
MIN_SCORE = 0.3
_KIND = "CASE WHEN url LIKE '%page=2%' THEN 'new' WHEN page_id % 5 < 2 THEN 'returned' ELSE 'found' END"
_PATH = "regexp_replace(regexp_extract(url, '//[^/]+/([^?#]*)', 1), '/', ' ')"


def page_catalog(spark: SparkSession, sf: str, returned: bool) -> DataFrame:
    """Pages as cases: title as recipient, path as reason, language as year, title and path as file name.

    A returned copy has a slip in the title, status words in its name and, without https, other content.
    """
    p = table(spark, sf, "pages").selectExpr(
        "page_id", "url", "regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang", f"{_TITLE} AS title", f"{_PATH} AS path", "sha1(html) AS hash")
    if returned:
        p = p.selectExpr("page_id", "url", "lang", "concat(substr(title, 1, 6), substr(title, 8)) AS title", "path",
                         "if(url LIKE 'https%', hash, sha1(url)) AS hash").selectExpr("*", "concat('Signed ', title, '_', path, ' (2).pdf') AS filename",
                         "if(lang = 'fr', 'F174', 'F10') AS form_type")
    else:
        p = p.selectExpr("*", "concat(title, '_', path, '.pdf') AS filename", "'F10' AS form_type")
    shared = ["filename", F.col("hash").alias("sha1"), "form_type", filename_key("filename").alias("fname"),
              norm_text("title").alias("recipient_name"), norm_text("path").alias("reason"), F.col("lang").alias("class_year")]
    if returned:
        own = [F.expr(_KIND).alias("kind")]
    else:
        own = [F.expr("url LIKE '%.html'").alias("missing"), F.expr("url LIKE '%#top'").alias("archived"), F.expr("length(title) > 3").alias("analysed")]
    return p.select(F.col("page_id").alias("id"), *shared, *own)


def _dice_sql(field: str) -> str:
    return f"""SELECT x.id AS i, y.id AS c, CASE WHEN x.{field} = y.{field} THEN CASE WHEN x.{field} = '' THEN 0 ELSE 1 END
    WHEN length(x.{field}) < 2 OR length(y.{field}) < 2 THEN 0 ELSE 2.0 * coalesce(h, 0) / (length(x.{field}) + length(y.{field}) - 2) END AS d
  FROM it x CROSS JOIN ct y LEFT JOIN (SELECT a.id AS i, b.id AS c, CAST(sum(least(a.n, b.n)) AS DOUBLE) AS h FROM gi_{field} a JOIN gc_{field} b ON a.g = b.g GROUP BY ALL) z
    ON z.i = x.id AND z.c = y.id"""


def _norm_sql(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


def _key_of(e: str) -> str:
    bare = f"regexp_replace(regexp_replace({e}, '(?i)\\.pdf$', ''), '\\(\\d+\\)', ' ', 'g')"
    words = "\\b(copy|signed|sign|sig|final|updated|update|scan|scanned|new|returned|done|completed?|rev\\d*|v\\d+)\\b"
    return f"trim(regexp_replace(regexp_replace({_norm_sql(bare)}, '{words}', ' ', 'g'), '\\s+', ' ', 'g'))"


_ITEMS = f"""raw AS (SELECT page_id, url, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, {_TITLE} AS title,
    replace(regexp_extract(url, '//[^/]+/([^?#]*)', 1), '/', ' ') AS path, sha1(html) AS hash FROM pages),
back AS (SELECT page_id, url, lang, substr(title, 1, 6) || substr(title, 8) AS title, path, CASE WHEN url LIKE 'https%' THEN hash ELSE sha1(url) END AS hash FROM raw),
it AS (SELECT page_id AS id, 'Signed ' || title || '_' || path || ' (2).pdf' AS filename, hash AS sha1, CASE WHEN lang = 'fr' THEN 'F174' ELSE 'F10' END AS form_type,
    {_key_of("('Signed ' || title || '_' || path || ' (2).pdf')")} AS fname, {_norm_sql('title')} AS recipient_name, {_norm_sql('path')} AS reason, lang AS class_year, {_KIND} AS kind FROM back),
ct AS (SELECT page_id AS id, title || '_' || path || '.pdf' AS filename, hash AS sha1, 'F10' AS form_type,
    {_key_of("(title || '_' || path || '.pdf')")} AS fname, {_norm_sql('title')} AS recipient_name, {_norm_sql('path')} AS reason, lang AS class_year
    FROM raw WHERE NOT (url LIKE '%.html' OR url LIKE '%#top') AND length(title) > 3)"""
_GRAM_CTE = lambda name, src, f: f",\n{name} AS (SELECT id, substr({f}, i, 2) AS g, count(*) AS n FROM (SELECT id, {f}, unnest(range(1, length({f}))) AS i FROM {src}) GROUP BY ALL)"
_CAND = "WITH " + _ITEMS + "".join(
    _GRAM_CTE(f"gi_{f}", "it", f) + _GRAM_CTE(f"gc_{f}", "ct", f) + f",\nd_{f} AS ({_dice_sql(f)})" for f in ("fname", *FIELDS)
) + f""",
s AS (SELECT x.id AS i, y.id AS c, y.filename, x.sha1 = y.sha1 AS identical, f.d AS fn, r.d AS rn, o.d AS rs, l.d AS yr, x.form_type AS itype,
  3.0 * (x.recipient_name <> '' AND y.recipient_name <> '')::INT AS w1, 2.0 * (x.reason <> '' AND y.reason <> '')::INT AS w2,
  0.5 * (x.class_year <> '' AND y.class_year <> '')::INT AS w3, CASE WHEN x.form_type <> y.form_type THEN 0.4 ELSE 1 END AS factor
  FROM d_fname f JOIN d_recipient_name r USING (i, c) JOIN d_reason o USING (i, c) JOIN d_class_year l USING (i, c) JOIN it x ON x.id = f.i JOIN ct y ON y.id = f.c WHERE x.kind <> 'new'),
u AS (SELECT *, CAST(factor * CASE WHEN w1 + w2 + w3 < 2 THEN 0.9 * fn ELSE 0.45 * fn + 0.55 * (w1 * rn + w2 * rs + w3 * yr) / (w1 + w2 + w3) END AS DOUBLE) AS base FROM s),
t AS (SELECT *, CASE WHEN identical THEN 1 ELSE base END AS raw FROM u),
cand AS (SELECT i AS item_id, c AS case_id, filename, CAST(floor(CAST(raw AS DOUBLE) * 100 + 0.5) / 100 AS DOUBLE) AS score, identical,
  CASE WHEN identical THEN 'identical to the copy on file' ELSE concat_ws('; ', CASE WHEN fn >= 0.999 THEN 'same file name' WHEN fn >= 0.6 THEN 'similar file name' END,
    CASE WHEN w1 + w2 + w3 >= 2 THEN 'same ' || nullif(concat_ws(', ', CASE WHEN w1 > 0 AND rn >= 0.9 THEN 'recipient' END, CASE WHEN w2 > 0 AND rs >= 0.9 THEN 'reason' END, CASE WHEN w3 > 0 AND yr >= 0.9 THEN 'class year' END), '') END,
    CASE WHEN w1 + w2 + w3 >= 2 THEN 'different ' || nullif(concat_ws(', ', CASE WHEN w1 > 0 AND rn < 0.5 THEN 'recipient' END, CASE WHEN w2 > 0 AND rs < 0.5 THEN 'reason' END), '') END,
    CASE WHEN factor < 1 THEN 'it''s an ' || itype END) END AS why
  FROM t WHERE CAST(raw AS DOUBLE) >= {MIN_SCORE}),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, filename, case_id) AS INT) AS rank FROM cand
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, filename, case_id) <= 6)
"""


def page_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = page_catalog(spark, sf, True)
    return items, M.document_candidates(items, page_catalog(spark, sf, False), FIELDS, INDEXED, MIN_SCORE)


@query("document_candidates", "J5, W3", _CAND + "SELECT * FROM top")
def document_candidates(spark, sf):
    return page_candidates(spark, sf)[1].withColumn("why", F.concat_ws("; ", "why"))


@query("match_suggestions", "W4", _CAND + """
, two AS (SELECT item_id, max(score) AS s1, min_by(case_id, (-score, filename, case_id)) AS c1 FROM top GROUP BY 1),
second AS (SELECT item_id, score AS s2 FROM top QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, filename, case_id) = 2)
SELECT it.id AS item_id, CASE WHEN s1 >= 0.4 THEN 'replace' ELSE 'new' END AS action, CASE WHEN s1 >= 0.4 THEN c1 END AS case_id,
  CASE WHEN s1 >= 0.7 AND (s2 IS NULL OR round(s1 - s2, 10) >= 0.1) THEN class_year = 'en' ELSE coalesce(s1 >= 0.4, false) END AS review
FROM it LEFT JOIN two ON two.item_id = it.id LEFT JOIN second ON second.item_id = it.id""")
def match_suggestions(spark, sf):
    items, cands = page_candidates(spark, sf)
    return M.suggest(items.selectExpr("id AS item_id", "class_year = 'en' AS warned"), cands)


# ---- boxes ------------------------------------------------------------------------------------------------

_BOX = ["l_orderkey AS page", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        "l_quantity / 60 AS x0", "l_discount * 8 AS y0", "l_quantity / 60 + 0.05 + l_tax / 4 AS x1", "l_discount * 8 + 0.03 AS y1",
        "CASE l_returnflag WHEN 'R' THEN 'Signature' WHEN 'A' THEN 'Text' ELSE 'CheckBox' END AS ftype",
        "concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS id"]


def boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as boxes of a page: open lines are the template, the others what was found."""
    b = table(spark, sf, "lineitem").selectExpr(*_BOX)
    name = F.concat(F.lit("Field_"), F.col("l_returnflag"))
    slots = b.where("l_linestatus = 'O'").select("page", F.col("id").alias("slot"), "ftype", name.alias("name"), "x0", "y0", "x1", "y1")
    widgets = b.where("l_linestatus = 'F'").select(
        "page", F.col("id").alias("widget"), "ftype", F.lower(F.regexp_replace(name, "_", " ")).alias("name"), (F.col("l_partkey") > F.col("l_suppkey") * 10).alias("has_value"), "x0", "y0", "x1", "y1")
    return slots, widgets


_BOX_SQL = """b AS (SELECT l_orderkey AS page, l_linenumber || '.' || l_partkey || '.' || l_suppkey AS id, l_returnflag, l_linestatus, l_partkey, l_suppkey,
  l_quantity / 60 AS x0, l_discount * 8 AS y0, l_quantity / 60 + 0.05 + l_tax / 4 AS x1, l_discount * 8 + 0.03 AS y1,
  CASE l_returnflag WHEN 'R' THEN 'Signature' WHEN 'A' THEN 'Text' ELSE 'CheckBox' END AS ftype FROM lineitem)"""


#: Lines of an order in the driver's tables that the SQL below can hold; the library has no such bound.
MOST_LINES = 14


def _cheapest_sql(slots: str, widgets: str, most: int = MOST_LINES, ties: bool = False) -> str:
    """The assignment of least cost of each page by trying every subset of its fields, one box after the other.

    slots, widgets: queries of (page, id, ftype, name, has_value, x0..y1), `most` a page at most. With `ties` costs are summed in whole
    billionths, and of equal totals the one counts that gives the first box the first field, then the second box, and so on.
    """
    if ties:
        total, first = "CAST(floor(c.cost * 1e9 + 0.5) AS BIGINT)", "{'t': total, 'p': path}"
        kind, by = "BIGINT", "id, x0, y0, x1, y1, ftype, name, has_value"
    else:
        total, first, kind, by = "c.cost", "total", "DOUBLE", "id"
    steps = "".join(f"""
d{i} AS (SELECT page, mask, min(total) AS total, arg_min(path, {first}) AS path FROM (
  SELECT page, mask, total, path FROM d{i - 1}
  UNION ALL SELECT d.page, d.mask | (1 << c.j), d.total + {total}, list_append(d.path, c.i * 64 + c.j) FROM d{i - 1} d JOIN c ON c.page = d.page AND c.i = {i - 1} AND (d.mask & (1 << c.j)) = 0
) GROUP BY page, mask),""" for i in range(1, most + 1))
    return f"""
sl AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {by}) - 1 AS i FROM ({slots})),
wi AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {by}) - 1 AS j FROM ({widgets})),
p AS (SELECT s.page, s.i, w.j, s.id AS slot, w.id AS widget, sqrt(pow((s.x0 + s.x1) / 2 - (w.x0 + w.x1) / 2, 2) + pow((s.y0 + s.y1) / 2 - (w.y0 + w.y1) / 2, 2)) AS d,
    abs((s.x1 - s.x0) - (w.x1 - w.x0)) + abs((s.y1 - s.y0) - (w.y1 - w.y0)) AS sz,
    abs(s.x0 - w.x0) <= 0.02 AND abs(s.x1 - w.x1) <= 0.02 AND abs(s.y0 - w.y0) <= 0.02 AND abs(s.y1 - w.y1) <= 0.02 AS tight,
    CASE WHEN s.ftype = w.ftype THEN 0 WHEN s.ftype IN ('Signature', 'Text') AND w.ftype IN ('Signature', 'Text') THEN 0.035 END AS compat,
    CASE WHEN s.name = w.name THEN 0.02 ELSE 0 END + CASE WHEN w.has_value THEN 0.03 ELSE 0 END AS bonus
  FROM sl s JOIN wi w ON s.page = w.page),
c AS (SELECT page, i, j, slot, widget, tight AND compat IS NOT NULL AS tight, CAST(CASE WHEN compat IS NULL THEN 9 WHEN tight THEN 0.1 * (d + 0.35 * sz) + compat - bonus ELSE 0.01 + d + 0.35 * sz + compat - bonus END AS DOUBLE) AS cost FROM p),
n AS (SELECT page, least(max(i), max(j)) + 1 AS k FROM c GROUP BY page),
d0 AS (SELECT page, 0 AS mask, CAST(0 AS {kind}) AS total, CAST([] AS BIGINT[]) AS path FROM n),{steps}
best AS (SELECT d.page, arg_min(path, {first}) AS path FROM d{most} d JOIN n ON n.page = d.page AND bit_count(mask) = n.k GROUP BY d.page),
chosen AS (SELECT page, unnest(path) AS ij FROM best)
SELECT c.page, c.slot, c.widget, c.tight FROM chosen h JOIN c ON c.page = h.page AND c.i = h.ij // 64 AND c.j = h.ij % 64 WHERE c.cost <= 0.075"""


_NAMED_BOX = "page, id, ftype, l_returnflag AS name, l_partkey > l_suppkey * 10 AS has_value, x0, y0, x1, y1 FROM b WHERE l_linestatus"


@query("widget_matches", "J16", f"WITH {_BOX_SQL}," + _cheapest_sql(f"SELECT {_NAMED_BOX} = 'O'", f"SELECT {_NAMED_BOX} = 'F'", 20, True))
def widget_matches(spark, sf):
    return assign_widgets(*boxes(spark, sf), 0.02, 0.02).select("page", "slot", "widget", "tight")


# Boxes of a page that stand close together, and fields each a little beside its box, of which some are missing on either side.
_CLOSE = """SELECT l_orderkey AS page, concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS id, CASE l_returnflag WHEN 'R' THEN 'Signature' WHEN 'A' THEN 'Text' ELSE 'CheckBox' END AS ftype,
  l_returnflag AS name, l_partkey % 3 = 0 AS has_value, l_suppkey, l_partkey, CAST(l_quantity % 4 / 50 + l_partkey % 97 / 20000e0 AS DOUBLE) AS x0, CAST(l_discount / 5 + l_suppkey % 89 / 20000e0 AS DOUBLE) AS y0,
  CAST(l_partkey % 37 / 900e0 - 2e-2 AS DOUBLE) AS dx, CAST(l_suppkey % 31 / 900e0 - 17e-3 AS DOUBLE) AS dy, CAST(5e-2 + l_tax / 9 AS DOUBLE) AS wide FROM lineitem"""
_CLOSE_SLOTS = f"SELECT page, id, ftype, name, false AS has_value, x0, y0, x0 + 6e-2 AS x1, y0 + 2e-2 AS y1 FROM ({_CLOSE}) WHERE l_suppkey % 11 <> 0"
_CLOSE_WIDGETS = f"""SELECT page, id, CASE WHEN l_partkey % 5 = 0 THEN 'Text' ELSE ftype END AS ftype, CASE WHEN l_suppkey % 4 = 0 THEN 'other' ELSE name END AS name, has_value,
  x0 + dx AS x0, y0 + dy AS y0, x0 + dx + wide AS x1, y0 + dy + 2e-2 AS y1 FROM ({_CLOSE}) WHERE l_suppkey % 7 <> 0"""


@query("widget_contention", "J16", "WITH" + _cheapest_sql(_CLOSE_SLOTS, _CLOSE_WIDGETS))
def widget_contention(spark, sf):
    """Fields that several boxes would take, and boxes that several fields would fit."""
    lines = table(spark, sf, "lineitem")
    slots, widgets = (spark.sql(q.replace("FROM lineitem", "FROM {lines}"), lines=lines).withColumnRenamed("id", c) for q, c in ((_CLOSE_SLOTS, "slot"), (_CLOSE_WIDGETS, "widget")))
    return assign_widgets(slots, widgets, 0.02, 0.02).select("page", "slot", "widget", "tight")


def words_and_boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and returned lines are words at a point, the others boxes of the same page."""
    b = table(spark, sf, "lineitem").selectExpr(*_BOX)
    w = b.where("l_returnflag <> 'N'").select("page", F.col("id").alias("word_no"), F.col("l_linestatus").alias("word"), F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    return w, b.where("l_returnflag = 'N'").select("page", F.col("id").alias("box"), "x0", "y0", "x1", "y1")


@query("word_boxes", "J17", f"""WITH {_BOX_SQL},
d AS (SELECT w.page, w.id AS word_no, x.id AS box, (x.x1 - x.x0) * (x.y1 - x.y0) AS area,
  sqrt(pow(greatest(x.x0 - w.x0, 0, w.x0 - x.x1), 2) + pow(greatest(x.y0 - w.y0, 0, w.y0 - x.y1), 2)) AS d
  FROM b w JOIN b x ON w.page = x.page AND w.l_returnflag <> 'N' AND x.l_returnflag = 'N')
SELECT page, word_no, box FROM d WHERE d <= 0.12 QUALIFY row_number() OVER (PARTITION BY page, word_no ORDER BY floor(d * 1e9 + 0.5), floor(area * 1e9 + 0.5), box) = 1""")
def word_boxes(spark, sf):
    return M.assign_words(*words_and_boxes(spark, sf), 0.12).select("page", "word_no", "box")


@query("words_minus_printed", "U3", """
WITH f AS (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS k
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents)),
p AS (SELECT w, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY ALL)
SELECT f.doc_id, sum(CASE WHEN k > coalesce(c, 0) THEN 1 ELSE 0 END)::BIGINT AS kept, min(pos) FILTER (WHERE k > coalesce(c, 0)) AS first_kept, max(pos) FILTER (WHERE k > coalesce(c, 0)) AS last_kept
FROM f LEFT JOIN p ON p.w = f.w GROUP BY 1 HAVING kept > 0""")
def words_minus_printed(spark, sf):
    """Document words left after taking out the words of the passages, one for one."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    found = d.select(F.col("doc_id").alias("page"), F.lit("text").alias("box"), "word", "word_no")
    counts = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    left = M.subtract_counts(found, cut_lineage(counts), ["word"], None)
    return left.groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("kept"), F.min("word_no").alias("first_kept"), F.max("word_no").alias("last_kept"))


# ---- layouts ------------------------------------------------------------------------------------------------



@query("layout_classes", "F31", """
WITH raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
t0 AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM raw) GROUP BY ALL),
t1 AS (SELECT label, list(m ORDER BY i) AS v FROM t0 GROUP BY label),
tc AS (SELECT label, list_transform(v, lambda x: x - list_avg(v)) AS v FROM t1),
t AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM tc),
pc AS (SELECT id, label, list_transform(v, lambda x: x - list_avg(v)) AS v FROM raw),
p AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM pc),
s AS (SELECT p.id, p.label AS hint, t.label AS template, list_dot_product(p.v, t.v) AS score FROM p, t),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, template) = 1)
SELECT best.id, best.template, round(best.score, 6) AS score, best.hint, round(h.score, 6) AS hint_score,
  best.hint <> best.template AND best.score - h.score > 0.2 AND h.score < 0.5 AS mislabeled FROM best JOIN s h ON h.id = best.id AND h.template = best.hint""")
def layout_classes(spark, sf):
    e = table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    templates = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        F.col("label").alias("template"), F.transform("v", lambda z: z["m"]).alias("vec"))
    pages = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("hint"))
    out = M.classify_layout(pages, templates, 10)
    return out.withColumn("score", F.round("score", 6)).withColumn("hint_score", F.round("hint_score", 6))


@query("top_candidates", "W3", """
SELECT l_suppkey AS item_id, l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 6""")
def top_candidates(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return keep_first(li, ["item_id"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 6).drop("l_extendedprice")


