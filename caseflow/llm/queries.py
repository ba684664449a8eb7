"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op4_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""")
def op4(spark, sf_dir):
    from .exact_dedup import dedup

    return dedup(read(spark, sf_dir, "documents")).drop("uid")


@query("op10_decontamination")
def op10(spark, sf_dir):
    from pyspark.sql import functions as F

    from .decontaminate import contamination

    found = contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


@query("op9_minmax_near_dedup")
def op9(spark, sf_dir):
    from .near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op1_packing")
def op1(spark, sf_dir):
    from .packing import pack

    return pack(spark, read(spark, sf_dir, "documents"))


@query("op6_record_files")
def op6(spark, sf_dir):
    from .record_file import round_trip

    return round_trip(spark, read(spark, sf_dir, "documents"))


@query("op3_secret_ledger")
def op3(spark, sf_dir):
    from .secrets import report

    return report(spark, read(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark, sf_dir):
    from .language_id import identify

    return identify(spark, read(spark, sf_dir, "documents"))


@query("op7_pairwise_quality")
def op7(spark, sf_dir):
    from .quality import rank

    return rank(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_gru_toxicity")
def op5(spark, sf_dir):
    from .toxicity import judge

    return judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_crf_extraction")
def op8(spark, sf_dir):
    from .html_extract import extract

    return extract(spark, read(spark, sf_dir, "pages"))


@query("op11_url_filter")
def op11(spark, sf_dir):
    from .url_filter import judge

    return judge(read(spark, sf_dir, "pages"))


@query("op12_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, 1 AS j FROM c UNION ALL SELECT lang, k, phrase, a, w, 2 FROM c WHERE k = 3),
s AS (
  SELECT u.lang, u.k, u.phrase, u.a, u.j, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts u
  JOIN f x ON x.lang = u.lang AND x.k = u.j AND x.phrase = array_to_string(u.w[1:u.j], ' ')
  JOIN f y ON y.lang = u.lang AND y.k = u.k - u.j AND y.phrase = array_to_string(u.w[u.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
m AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3)
  GROUP BY lang, phrase),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
  WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000""")
def op12(spark, sf_dir):
    from .collocations import collocations

    return collocations(spark, read(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    from .conversations import report

    return report(read(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
