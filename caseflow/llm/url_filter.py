"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Native throughout: scoring is a column expression without a shuffle, and training is one SQL expression over the small labelled table, in
which gradient descent folds over the rounds. A round takes every labelled URL's margin from the weights, then every weight's gradient
from the URLs that hold its n-grams, so it costs what the n-grams count, not URLs times weights.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows it up to `?`, `#` or the end. N-grams
are of three UTF-16 units, host and path framed and hashed apart, runs of digits as one 0; each part is scaled by the root of its number of n-grams.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged by its empty parts; repeated
rows are judged each; an empty table gives no rows; extra columns are left out. Labelled rows with a null are not learned from.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let

#: Fixed values: (host, path, verdict). A rule fits its host and all subdomains where the path begins with the rule's; the longest wins.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: Weights, of which the first is the bias; rounds, step and shrinkage of the descent.
WEIGHTS, ROUNDS, STEP, SHRINK = 8192, 300, 4.0, 0.0005
#: Labelled URLs that are learned from at most, the first by hash of the URL.
MOST_LABELLED = 2_000
BLOCK_FROM = 0.5

#: The small labelled table. Invented hosts; what to block, then what to allow.
BLOCKED_URLS = """
http://lucky-casino.example/en/12 https://www.casino-royal-slots.test/play https://best-casino-bonus.example/fr/9.html http://m.casino24.test/de/77/
http://online-bets.example/en/4?ref=a https://sports-bets.test/es/31 http://bets365-win.example/live http://www.free-bet-tips.test/en/8.html
https://poker-win.example/en/55/ http://big-win-jackpot.test/fr/6 http://slots-jackpot.example/spin https://roulette-win.test/de/5#top
http://cheap-meds.example/en/13 http://cheap-watches-replica.test/es/1 https://pills-shop.example/buy http://www.diet-pills-online.test/en/21
https://blog.pharma-pills.example/fr/2.html http://cheap-viagra-pills.test/de/90 http://generic-pills.example/en/3 https://rx-cheap-drugs.test/en/17/
http://adult-chat.example/en/5 https://www.adult-video.test/fr/44 http://xxx-tube.example/es/8 https://hot-adult-cams.test/en/61.html
http://x-rated.example/de/7 https://porn-x.test/en/19 http://sexy-cams-x.example/en/2/ https://adult-dating.test/en/71?ref=x
http://ads-server.example/click https://m.ads-banner.test/en/6 http://track-click.example/de/3 https://ad-track-pixel.test/fr/10/
http://popup-ads.example/en/26 https://click-track.test/r http://www.ads-network.example/es/18 https://tracker-ads.test/en/39.html
http://spam-mail.example/en/1 https://www.link-farm.test/en/84 http://seo-spam.example/fr/15 https://content-farm.test/de/28/
http://spam-links.example/es/5.html https://farm-spam-blog.test/en/33 http://free-download-crack.example/warez http://warez-keygen.test/en/9
http://free-money-fast.example/en/66 https://get-rich-quick.test/es/40 http://loan-cash-fast.example/de/11 https://free-crypto-win.test/en/29
""".split()
ALLOWED_URLS = """
http://daily-news.example/en/12 https://www.city-library.test/en/40.html https://university-press.example/fr/9 http://m.weather.test/de/77/
http://docs.software.example/en/4?ref=a https://museum-history.test/es/31 http://garden-journal.example/live http://www.cooking-notes.test/en/8.html
https://mathematics.example/en/55/ http://open-science.test/fr/6 http://mountain-travel.example/map https://river-times.test/de/5#top
http://teachers.example/en/13 http://furniture-makers.test/es/1 https://bookshop.example/buy http://www.healthcare-clinic.test/en/21
https://blog.pharmacy-students.example/fr/2.html http://nutrition.test/de/90 http://gardening.example/en/3 https://medicine-research.test/en/17/
http://families.example/en/5 https://www.film-archive.test/fr/44 http://music-lessons.example/es/8 https://theatre-listings.test/en/61.html
http://orchestra.example/de/7 https://painters.test/en/19 http://photography.example/en/2/ https://friends-association.test/en/71?ref=x
http://standards.example/click https://m.railway-timetable.test/en/6 http://hiking-trail.example/de/3 https://athletics.test/fr/10/
http://government.example/en/26 https://statistics.test/r http://www.national-parliament.example/es/18 https://election-results.test/en/39.html
http://letters.example/en/1 https://www.organic-agriculture.test/en/84 http://farmers-market.example/fr/15 https://countryside.test/de/28/
http://geography.example/es/5.html https://astronomy-blog.test/en/33 http://free-software.example/packages http://free-encyclopedia.test/en/9
http://economics.example/en/66 https://insurance-advice.test/es/40 http://history-of-banking.example/de/11 https://chess-tournament.test/en/29
https://www.thesis-archive.example/en/1024?page=2&ref=x http://blog.restoration.example/fr/8515#top http://m.athens.example/es/379?utm_source=feed
http://www.northern-station.example/en/7453?page=2 https://blog.translation.test/de/2211.html http://m.hearing.example/en/36089/
http://cathedral-choir.example/en/18 https://www.chatham-islands.test/fr/7 http://what-is-on.example/es/204/ https://thatcher-cottage.test/en/50.html
http://hathaway-house.example/de/31 http://m.theatre-hats.test/en/4 https://batten-and-sons.example/en/620 http://www.hadrian-wall.test/fr/81
http://northend-hotel.example/en/3071 https://blog.thornton.test/es/12/ http://henderson-tools.example/de/9003 https://indian-recipes.test/en/45
https://nation.test/en/14156 http://sheridan.example/es/33121 https://wharton.test/en/46478?page=2&ref=x http://edition.example/de/47694#top
""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], take: int | None = None) -> Column:
    """The longest rule that fits, as host and path; or its verdict. rules are a list written by hand: each is one branch."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    return F.coalesce(*[F.when(fits(r), r[2] if take == 2 else r[0] + r[1]) for r in ordered]) if rules else F.lit(None).cast("string")


def features(host: Column, path: Column, weights: int = WEIGHTS) -> Column:
    """array<struct<w: place of the weight, v: value>> of a URL; one entry for each n-gram."""
    def of(mark: str, s: Column) -> Column:
        grams = F.regexp_extract_all(s, F.lit("(?s)(?=(.{3}))"), 1)
        place = lambda g: (F.pmod(F.xxhash64(F.concat(F.lit(mark), g)), F.lit(weights - 1)) + 1).cast("int")
        value = lambda gs: (1 / F.sqrt(F.size(gs).cast("double"))).alias("v")
        return let(grams, lambda gs: F.transform(gs, lambda g: F.struct(place(g).alias("w"), value(gs))))

    digits = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(of("h", F.concat(F.lit("^"), host, F.lit("$"))), of("p", F.concat(F.lit("^"), digits, F.lit("$"))))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame, weights: int = WEIGHTS, rounds: int = ROUNDS) -> list[float]:
    """Weights of the regression. labelled: (url, label), label 1 for what is to be blocked; at most MOST_LABELLED different rows are used."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).dropna().distinct().orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED)
    host, path = parts(F.col("url"))
    data = rows.select("url", "label", features(host, path, weights).alias("f")).agg(
        F.sort_array(F.collect_list(F.struct("url", "label", "f"))).alias("rows")
    )
    # for each weight, the URLs that hold it; the bias is held by all with value 1
    flat = data.select(F.posexplode("rows").alias("i", "row")).select("i", F.explode("row.f").alias("f")).groupBy("f.w", "i").agg(F.sum("f.v").alias("v"))
    held = flat.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("held"))
    slots = labelled.sparkSession.range(1, weights).select(F.col("id").cast("int").alias("w")).join(held, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", "held"))).alias("slots"))
    both = data.withColumn("one", F.lit(1)).join(slots.withColumn("one", F.lit(1)), "one")  # two one-row tables
    step = f"""
        aggregate(sequence(1, {rounds}), array_repeat(0D, {weights}), (w, round) ->
          aggregate(array(transform(rows, r -> 1D / (1D + exp(-(w[0] + aggregate(r.f, 0D, (z, f) -> z + f.v * w[f.w])))) - r.label)), w, (old, miss) ->
            concat(
              array(old[0] - {STEP}D * aggregate(miss, 0D, (z, m) -> z + m) / greatest(size(rows), 1)),
              transform(slots, h -> if(h.held is null, 0D,
                old[h.w] - {STEP}D * (aggregate(h.held, 0D, (z, e) -> z + e.v * miss[e.i]) / greatest(size(rows), 1) + {SHRINK}D * old[h.w]))))))
    """
    got = both.select(F.expr(step).alias("w")).first()
    return list(got["w"]) if got and got["w"] else [0.0] * weights


def score(host: Column, path: Column, trained: list[float]) -> Column:
    """Probability of a URL to be blocked."""
    w = F.from_json(F.lit(json.dumps(trained)), "array<double>")  # folded into one literal
    return _sigmoid(F.get(w, F.lit(0)) + F.aggregate(features(host, path, len(trained)), F.lit(0.0), lambda z, f: z + f["v"] * F.get(w, f["w"])))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: (url, label)."""
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(BLOCKED_URLS)), " ")).alias("url"), F.lit(1).alias("label")).union(
        spark.range(1).select(F.explode(F.split(F.lit(" ".join(ALLOWED_URLS)), " ")), F.lit(0))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url); score is null where a rule decides."""
    rules = RULES if rules is None else rules
    trained = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    ruled = split.withColumns({"rule": rule_of(h, p, rules), "by_rule": rule_of(h, p, rules, 2)})
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), score(h, p, trained)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "score")
