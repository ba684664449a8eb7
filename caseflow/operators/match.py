"""Fuzzy joins: names, documents, boxes and vectors.

None of these compares everything with everything. Each builds keys that any pair within the limit must
share (proved in the docstrings), joins on those keys, and verifies the few pairs that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import (
    bigrams, cosine, let, name_key, name_parts, norm_text, numbered_bigrams, parts_distance, set_dice, unit_vector,
)
from ..functions.names import readings
from ..session import cut_lineage
from .candidates import best_cases, candidate_threshold
from .scale import is_true, keep_first, row_numbers, spread

SEP = "\x01"


# ---- shared pieces -----------------------------------------------------------------------------

def pair_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair of names, case ignored."""
    return F.array_join(F.array_sort(F.array(F.lower(a), F.lower(b))), SEP)


def without_ruled(pairs: DataFrame, a: str, b: str, distinct_pairs: DataFrame | None) -> DataFrame:
    """Drop pairs a person has ruled to be different people (distinct_pairs: a, b)."""
    if distinct_pairs is None:
        return pairs
    ruled = distinct_pairs.select(pair_key(F.col("a"), F.col("b")).alias("__p")).distinct()
    keyed = pairs.withColumn("__q", pair_key(F.col(a), F.col(b)))
    return keyed.join(ruled, F.col("__q") == F.col("__p"), "left_anti").drop("__q")


def canonicalise(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """The confirmed spelling of a name, else the name itself (aliases: name_lc, spelling)."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), V.WHITESPACE + "+", " "))
    keyed = df.withColumn("__c", clean)
    look = aliases.select(F.col("name_lc").alias("__l"), F.col("spelling").alias("__s"))
    return keyed.join(look, F.lower("__c") == F.col("__l"), "left").withColumn(
        out, F.coalesce("__s", "__c")
    ).drop("__c", "__l", "__s")


def _deletions(word: Column) -> Column:
    """The word with one letter removed, each way."""
    return F.when(F.length(word) > 0, F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)),
    )).otherwise(F.array().cast("array<string>"))


def _within_deletions(word: Column, k: int) -> Column:
    """The word and everything up to k deletions away."""
    def grow(level: Column) -> Column:
        return F.array_distinct(F.concat(level, F.flatten(F.transform(level, _deletions))))

    out = F.array(word)
    for _ in range(k):
        out = let(out, grow)
    return out


def _variants(word: Column, k: int) -> Column:
    """Deletions a word may take part in: never more than a third of its letters."""
    allowed = F.least(F.lit(k), F.floor(F.length(word) / 3).cast("int"))
    out = F.array(word)
    for n in range(1, k + 1):
        out = F.when(allowed >= n, _within_deletions(word, n)).otherwise(out)
    return out


# ---- near-duplicate spellings -------------------------------------------------------------------

_SHORT, _OVERLAP = 26, 25


def near_duplicate_names(
    names: DataFrame, name: str = "name", count: str = "n", min_len: int = 4, distinct_pairs: DataFrame | None = None,
    hot_piece: int = 1000,
) -> DataFrame:
    """Pairs of different spellings at most two edits apart, once each, case ignored (a, b, a_n, b_n, edits).

    names: one row per distinct spelling. Two strings within two edits share a string two deletions or fewer
    from both, so short names meet on hashes of those. Of three pieces of a longer string at least one is left
    whole by two edits and moves at most two places, so longer names meet on (length, piece number, piece).
    Names of 25 and 26 letters take part in both, which covers pairs across the border. A piece that more than
    `hot_piece` names hold (a common first word) does not bring them all together: with that piece whole, what is
    around it is within two edits, so those names meet on the piece and the two-deletion hashes of the rest. A
    hash or a piece only proposes a pair; the edit distance decides.
    """
    base = names.select(
        F.col(name).alias("s"), F.lower(name).alias("l"), F.col(count).alias("n")
    ).where(F.length("l") >= min_len).withColumn("len", F.length("l"))
    base = spread(base, "s")

    short = base.where(F.col("len") <= _SHORT).select(
        "s", F.explode(F.transform(_within_deletions(F.col("l"), 2), lambda x: F.xxhash64(x))).alias("k")
    )
    by_deletion = short.alias("x").join(short.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.s") < F.col("y.s")))
    by_deletion = by_deletion.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))

    long = base.where(F.col("len") >= _OVERLAP).select("s", "l", "len")
    start = lambda n, i: F.floor(n / 3).cast("int") * i + 1
    width = lambda n, i: F.when(i == 2, n - F.floor(n / 3).cast("int") * 2).otherwise(F.floor(n / 3).cast("int"))
    piece = lambda n, i, at: F.struct(
        F.xxhash64(n, i, F.substr(F.col("l"), at, width(n, i))).alias("k"), at.alias("at"), width(n, i).alias("w")
    )
    own = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: piece(F.col("len"), i, start(F.col("len"), i)))
    probes = F.flatten(F.transform(F.sequence(F.col("len") - 2, F.col("len")), lambda n: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(
            F.sequence(F.greatest(start(n, i) - 2, F.lit(1)), start(n, i) + 2), lambda at: piece(n, i, at)
        )
    ))))
    indexed = long.select(F.col("s").alias("b"), "l", F.inline(own))
    probing = long.select(F.col("s").alias("a"), "l", F.inline(F.array_distinct(probes)))
    crowded = cut_lineage(indexed.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > hot_piece).select("k"), "pieces")
    calm = probing.join(crowded, "k", "left_anti").select("a", "k").join(
        indexed.join(crowded, "k", "left_anti").select("b", "k"), "k"
    )
    rest = F.concat(F.substr("l", F.lit(1), F.col("at") - 1), F.lit(SEP), F.substr(F.col("l"), F.col("at") + F.col("w")))
    around = F.explode(F.transform(_within_deletions(rest, 2), lambda x: F.xxhash64(F.col("k"), x))).alias("r")
    busy = probing.join(crowded, "k").select("a", around).join(indexed.join(crowded, "k").select("b", around), "r")
    by_piece = calm.select("a", "b").unionByName(busy.select("a", "b")).where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )

    close = by_deletion.unionByName(by_piece).distinct().withColumn(
        "edits", F.levenshtein(F.lower("a"), F.lower("b"), 2)
    ).where((F.col("edits") >= 0) & (F.lower("a") != F.lower("b")))
    close = without_ruled(close, "a", "b", distinct_pairs)
    n_of = lambda side: base.select(F.col("s").alias(side), F.col("n").alias(f"{side}_n"))
    return close.join(n_of("a"), "a").join(n_of("b"), "b").select("a", "b", "a_n", "b_n", "edits")


# ---- names of people ------------------------------------------------------------------------------

def _name_keys(p: Column) -> Column:
    """Keys two names within distance 2 must share under some reading.

    The distance is family edits + best given edits <= 2, so it splits as (0, <=2), (<=1, <=1) or (<=2, 0).
    Words within k edits share a string at most k deletions from each. Each key joins both words, so a common
    given name alone never forms a key. Keys don't say which word is the family's: the one left whole comes first, or else the lesser
    one, so the two readings of a two-word name have the same keys and one is enough. One-word names only equal identical one-word names.
    """
    def keys(r: Column) -> Column:
        fam = r["family"]
        def per_given(g: Column) -> Column:
            whole = lambda w, others: F.transform(others, lambda x: F.xxhash64(F.lit(0), w, x))
            both = let(_variants(g, 1), lambda gs: F.flatten(F.transform(_variants(fam, 1), lambda f: F.transform(
                gs, lambda x: F.xxhash64(F.lit(1), F.least(f, x), F.greatest(f, x))
            ))))
            return F.concat(whole(fam, _variants(g, 2)), both, whole(g, _variants(fam, 2)))
        return F.flatten(F.transform(r["given"], per_given))

    ways = F.when(F.size(p["core"]) == 2, F.slice(readings(p), 1, 1)).otherwise(readings(p))
    full = F.array_distinct(F.flatten(F.transform(ways, keys)))
    lone = F.when(F.size(p["core"]) == 1, F.array(F.xxhash64(F.lit(3), F.get(p["core"], F.lit(0)))))
    return F.when(F.size(p["core"]) >= 2, full).otherwise(F.coalesce(lone, F.array().cast("array<bigint>")))


def name_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names of both sides, numbered, with their parts (id, name, p, in_left, in_right), written once."""
    both = left.select("name", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("name", F.lit(0).alias("l"), F.lit(1).alias("r"))
    ).groupBy("name").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    rows = spread(both, "name").select("name", name_parts("name").alias("p"), (F.col("l") == 1).alias("in_left"), (F.col("r") == 1).alias("in_right"))
    return cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()), "names")


def _pairs(index: DataFrame, max_distance: int) -> DataFrame:
    """Keys are a hundred times a name's share of the files, and parts some ten times: both are merged, never sent to the driver."""
    keyed = spread(index, "id").select("id", "in_left", "in_right", F.explode(_name_keys(F.col("p"))).alias("k"))
    lk = keyed.where("in_left").select(F.col("id").alias("l"), "k")
    rk = keyed.where("in_right").select(F.col("id").alias("r"), "k")
    met = lk.hint("merge").join(rk, "k").select("l", "r").distinct()
    left = index.select(F.col("id").alias("l"), "name", F.col("p").alias("pl"))
    right = index.select(F.col("id").alias("r"), F.col("name").alias("candidate"), F.col("p").alias("pr"))
    scored = met.join(left.hint("merge"), "l").join(right.hint("merge"), "r").select(
        "name", "candidate", parts_distance(F.col("pl"), F.col("pr")).alias("dist")
    )
    return scored.where(F.col("dist") <= max_distance)


def name_pairs(left: DataFrame, right: DataFrame, max_distance: int = V.NAME_MAX_DISTANCE) -> DataFrame:
    """Pairs (name, candidate, dist) within the distance; each input has a column `name`."""
    return _pairs(name_index(left, right), max_distance)


def best_match(
    left: DataFrame, candidates: DataFrame, max_distance: int = V.NAME_MAX_DISTANCE,
    distinct_pairs: DataFrame | None = None,
) -> DataFrame:
    """The nearest candidate per name (name, match, dist, ambiguous).

    left: name. candidates: name, ord; at equal distance the first by ord wins, and the match is ambiguous if
    another candidate at that distance is itself some letters away from the winner.
    """
    order = candidates.groupBy("name").agg(F.min("ord").alias("ord"))
    index = name_index(left, candidates)
    pairs = without_ruled(_pairs(index, max_distance), "name", "candidate", distinct_pairs)
    ranked = cut_lineage(pairs.join(order.select(F.col("name").alias("candidate"), "ord").hint("merge"), "candidate"), "pairs")
    best = ranked.groupBy("name").agg(F.min(F.struct("dist", "ord", "candidate")).alias("w"))
    tied = ranked.join(best.hint("merge"), "name").where(
        (F.col("dist") == F.col("w.dist")) & (F.col("candidate") != F.col("w.candidate"))
    ).select("name", F.col("w.candidate").alias("winner"), "candidate")
    parts = lambda side, out: index.select(F.col("name").alias(side), F.col("p").alias(out))
    rivals = tied.join(parts("winner", "pw").hint("merge"), "winner").join(parts("candidate", "pc").hint("merge"), "candidate")
    verdict = rivals.groupBy("name").agg(F.bool_or(parts_distance(F.col("pw"), F.col("pc")) > 0).alias("ambiguous"))
    return best.join(verdict.hint("merge"), "name", "left").select(
        "name", F.col("w.candidate").alias("match"), F.col("w.dist").alias("dist"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def resolve_parties(
    names: DataFrame, parties: DataFrame, aliases: DataFrame | None = None, distinct_pairs: DataFrame | None = None
) -> DataFrame:
    """Party key for each written name (name, key, party): exact key first, then an unambiguous near match.

    parties: key, name, ord. A name that matches nobody keeps its own key.
    """
    src = names.select("name").distinct()
    src = canonicalise(src, "name", aliases, "canon") if aliases is not None else src.withColumn("canon", F.col("name"))
    src = src.withColumn("key", name_key("canon"))
    known = cut_lineage(parties.groupBy("key").agg(F.min_by("name", "ord").alias("party"), F.min("ord").alias("ord")))
    exact = cut_lineage(src.join(known.select("key", "party"), "key", "left"))
    todo = exact.where(F.col("party").isNull() & (F.col("key") != "")).select("name")
    near = best_match(todo, known.select(F.col("party").alias("name"), "ord"), distinct_pairs=distinct_pairs)
    near = near.where(~F.col("ambiguous")).select("name", "match")
    return exact.join(near, "name", "left").select(
        "name", F.when(F.col("match").isNotNull(), name_key("match")).otherwise(F.col("key")).alias("key"),
        F.coalesce("party", "match").alias("party"),
    )


def connected_spellings(decisions: DataFrame) -> DataFrame:
    """Final spelling of every name tied by "same person" answers (name, root, spelling).

    decisions: a, b, spelling, ord (lower-case names). Components by least label with pointer jumping,
    until no label changes; each round is reliably checkpointed. The latest decision of a component gives its spelling.
    """
    links = decisions.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        decisions.select(F.col("b").alias("u"), F.col("a").alias("v"))
    ).unionByName(decisions.select(F.col("a").alias("u"), F.lower("spelling").alias("v"))).unionByName(
        decisions.select(F.lower("spelling").alias("u"), F.col("a").alias("v"))
    ).distinct()
    links = cut_lineage(links)
    labels = cut_lineage(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        seen = links.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v")
        least = seen.groupBy("u").agg(F.min("r").alias("r")).join(labels, "u").select(
            "u", F.least("r", "root").alias("root"), F.col("root").alias("old")
        )
        hop = labels.select(F.col("u").alias("root"), F.col("root").alias("up"))
        step = cut_lineage(least.join(hop, "root").select("u", F.least("root", "up").alias("root"), "old"))
        changed = step.where(F.col("root") != F.col("old")).limit(1).count()
        labels = step.select("u", "root")
        if not changed:
            break
    latest = decisions.join(labels.withColumnRenamed("u", "a"), "a").groupBy("root").agg(
        F.max_by("spelling", "ord").alias("spelling")
    )
    return labels.join(latest, "root").select(F.col("u").alias("name"), "root", "spelling")


# ---- bigram overlap ---------------------------------------------------------------------------------

def bigram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, c) of normalised texts of any length."""
    return texts.select(key, F.explode(bigrams(text)).alias("gram")).groupBy(key, "gram").agg(
        F.count("*").alias("c")
    )


def multiset_dice(pairs: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dice of given pairs (a, b) from bigram counts: intersection size is the sum of the smaller counts."""
    ca = counts.select(F.col("key").alias("a"), "gram", F.col("c").alias("ca"))
    cb = counts.select(F.col("key").alias("b"), "gram", F.col("c").alias("cb"))
    hits = pairs.join(ca, "a").join(cb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("hit"))
    n = lambda side: sizes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"))
    return pairs.join(hits, ["a", "b"], "left").join(n("a"), "a").join(n("b"), "b").select(
        "a", "b", (2.0 * F.coalesce("hit", F.lit(0)) / (F.col("na") + F.col("nb"))).alias("dice")
    )


#: Members of a side's sets (eight bytes each) up to which that side is sent to every task.
FEW_MEMBERS = 1_000_000


def similar_values(values: DataFrame, threshold: float) -> DataFrame:
    """Ordered pairs of distinct normalised texts with Dice >= threshold (a, b, dice), equal ones included.

    values: v, and where given `i` and `c`, whether an item or a case holds it: then only pairs of an item's and a case's value are
    sought. Repeated bigrams are numbered, so a text is a set and Dice >= t needs an overlap of at least
    t/(2-t) of either set. Put the rarest first: two such sets share one of their first
    n - ceil(t/(2-t) n) + 1 members. At the first one they share, neither can have fewer members left than the
    overlap needed, t/2 of both sizes; that also bounds how much the sizes differ. Sets are numbers that stay where their text's number
    puts them; if the cases' sets have few members, those go to all tasks, and no pair is moved.
    """
    alpha = threshold / (2.0 - threshold)
    held = ("i", "c")
    flags = [(F.max(k) if k in values.columns else F.lit(True)).alias(k) for k in held]
    vals = values.where(F.coalesce("v", F.lit("")) != "").groupBy("v").agg(F.count("*").alias("__n"), *flags).drop("__n")
    # numbers given while writing the table stay as written
    vals = cut_lineage(vals.withColumn("id", F.monotonically_increasing_id()), "values")
    counts = spread(vals, "id").select("id", *held, F.explode(bigrams("v")).alias("gram")).groupBy("id", *held, "gram").agg(F.count("*").alias("n"))
    df = vals.select(F.explode(F.array_distinct(bigrams("v"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    # normalised texts have 37 x 37 bigrams at most
    weighed = counts.join(F.broadcast(df), "gram").select("id", *held, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"), "gram", "df")
    letter = lambda k: F.ascii(F.substr("gram", F.lit(k), F.lit(1))).cast("bigint")
    token = F.struct(
        (F.col("df") / (F.col("nth") * F.col("nth"))).alias("w"),
        (F.shiftleft(letter(1), 42) + F.shiftleft(letter(2), 21) + F.col("nth")).alias("t"),
    )
    sets = weighed.groupBy("id", *held).agg(F.array_sort(F.collect_list(token)).alias("s"))
    sets = cut_lineage(sets.select("id", *held, F.transform("s", lambda x: x["t"]).alias("s"), F.size("s").alias("n")), "sets")
    few = (sets.where("c").agg(F.sum("n")).first()[0] or 0) <= FEW_MEMBERS
    near = F.broadcast if few else lambda side: side.hint("merge")
    keep = F.col("n") - F.ceil(F.col("n") * alpha - 1e-9).cast("int") + 1
    heads = spread(sets, "id").select("id", "n", (F.col("i") & F.col("c")).alias("x"), *held, F.posexplode(F.slice("s", F.lit(1), keep)).alias("at", "t"))
    heads = heads.withColumn("rest", F.col("n") - F.col("at"))
    x = heads.where("i").select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("x").alias("xa"), "t")
    y = heads.where("c").select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("x").alias("xb"), "t")
    both = F.col("xa") & F.col("xb")
    once = (F.col("ia") < F.col("ib")) | ((F.col("ia") != F.col("ib")) & ~both)  # two values that both sides hold meet once
    need = (F.col("na") + F.col("nb")) * (threshold / 2) - 1e-9
    met = x.join(near(y), "t").where(once & (F.least("ra", "rb") >= need)).select("ia", "ib", both.alias("both")).distinct()
    sa = sets.where("i").select(F.col("id").alias("ia"), F.col("s").alias("sa"))
    sb = sets.where("c").select(F.col("id").alias("ib"), F.col("s").alias("sb"))
    scored = met.join(sa.hint("merge"), "ia").join(near(sb), "ib").select(
        "ia", "ib", "both", (2.0 * F.size(F.array_intersect("sa", "sb")) / (F.size("sa") + F.size("sb"))).alias("dice")
    ).where(F.col("dice") >= threshold)
    scored = scored.join(vals.select(F.col("id").alias("ia"), F.col("v").alias("a")), "ia").join(vals.select(F.col("id").alias("ib"), F.col("v").alias("b")), "ib")
    scored = cut_lineage(scored.select("a", "b", "dice", "both"), "similar")
    same = vals.where("i and c").select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("dice"))
    turned = scored.where("both").select(F.col("b").alias("a"), F.col("a").alias("b"), "dice")
    return same.unionByName(scored.drop("both")).unionByName(turned)


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left, right, dice) of keys of two tables (key, s) of normalised texts with Dice >= threshold, of any sizes.

    A Dice of t needs sizes within a factor of (2 - t) / t of each other, so texts beyond what the other table's shortest and longest
    allow are left out before anything is cut into bigrams; the rest meet by `similar_values`. Null and empty texts have no pairs.
    """
    reach = (2.0 - threshold) / threshold
    size = F.greatest(F.length("s") - 1, F.lit(1))

    def within(df: DataFrame, other: DataFrame) -> DataFrame:
        ends = other.where("s <> ''").agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
        return df.where(F.lit(False)) if ends["lo"] is None else df.where((F.col("s") != "") & (size * reach >= ends["lo"] - 1e-9) & (size <= ends["hi"] * reach + 1e-9))

    x, y = within(left, right), within(right, left)
    held = lambda df, i: df.select(F.col("s").alias("v"), F.lit(i).alias("i"), F.lit(not i).alias("c"))
    close = similar_values(held(x, True).unionByName(held(y, False)), threshold)
    pairs = x.select(F.col("key").alias("left"), F.col("s").alias("a")).join(close, "a")
    return pairs.join(y.select(F.col("key").alias("right"), F.col("s").alias("b")), "b").select("left", "right", "dice")


# ---- candidate documents ------------------------------------------------------------------------------

def document_candidates(
    items: DataFrame, catalog: DataFrame, fields: dict[str, float], indexed: list[str] | None = None,
    min_score: float = V.CANDIDATE_MIN, top: int = V.CANDIDATE_TOP, sent: DataFrame | None = None,
    not_self: bool = False,
) -> DataFrame:
    """The best catalog cases per pulled item (item_id, case_id, filename, score, identical, why, rank).

    items and catalog: id, fname (file name key), filename, sha1, form_type, and one normalised text column per
    field. Cases that are missing, archived or not analysed (columns `missing`, `archived`, `analysed`, where there are) are never
    candidates, and items of kind `new` have none. `why` lists the reasons in words. Identical content scores 1. Every item is compared with every case
    (`best_cases`), and only pairs with some indexed part similar enough are scored: `candidate_threshold` shows that no other pair can reach
    min_score, so nothing is lost. Choose selective fields to index; the fewer, the higher min_score has to be. `sent`: case_id, step it was sent for; it counts for items of kind
    `returned` and the same step (columns kind, step).
    """
    indexed = list(fields) if indexed is None else indexed
    bonus = V.SENT_BONUS if sent is not None else 0.0
    if candidate_threshold(fields, indexed, min_score, bonus) <= 0:
        raise ValueError("index more fields or raise min_score: a pair could qualify on the other fields alone")
    parts = ("fname", *fields)
    for c in ("missing", "archived"):
        if c in catalog.columns:
            catalog = catalog.where(~is_true(F.col(c)))
    if "analysed" in catalog.columns:
        catalog = catalog.where(F.coalesce("analysed", F.lit(True)))
    if "kind" in items.columns:
        items = items.where(~F.col("kind").eqNullSafe("new"))
    back = None
    if sent is not None:  # the items that come back for the step a case was sent for
        back = items.where("kind = 'returned'").select(F.col("id").alias("b_id"), F.col("step").alias("b_step"))

    def side(df: DataFrame, p: str) -> DataFrame:
        """One side with the numbered bigrams of every part, written once."""
        plain = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "filename", "sha1", "form_type")],
                          *[F.coalesce(c, F.lit("")).alias(f"{p}_{c}") for c in parts])
        spread_out = spread(plain, f"{p}_id")
        return cut_lineage(spread_out.select("*", *[F.transform(numbered_bigrams(f"{p}_{c}"), lambda g: F.xxhash64(g)).alias(f"{p}_{c}_g") for c in parts]), "side")

    it, ct = side(items, "i"), side(catalog, "c")
    found = _candidates(it, ct, fields, indexed, min_score, sent, back, not_self, top)
    best = keep_first(found, ["item_id"], [F.desc("score"), F.col("filename"), F.col("case_id")], top)
    by = W.partitionBy("item_id").orderBy(F.desc("score"), "filename", "case_id")  # `top` rows of an item at most
    return best.withColumn("rank", F.row_number().over(by))


def _candidates(it, ct, fields, indexed, floor, sent, back, not_self, top=V.CANDIDATE_TOP) -> DataFrame:
    """The `top` best pairs of each item that score `floor` or more."""
    pairs = best_cases(it, ct, fields, indexed, floor, top, sent, back, not_self)
    rows = pairs.distinct().join(it, "i_id").join(ct, "c_id")
    of = lambda f: set_dice(*(F.col(f"{p}_{f}{g}") for g in ("", "_g") for p in ("i", "c")))
    # a row generated once: as plain columns they would be computed anew by the filter and by every reason
    scored = rows.select("*", F.inline(F.array(F.struct(*[of(f).alias(f"__d_{f}") for f in ("fname", *fields)]))))
    d = {f: F.col(f"__d_{f}") for f in ("fname", *fields)}
    if sent is not None:
        was = sent.select(F.col("case_id").alias("c_id"), F.col("step").alias("s_step")).join(back, F.col("s_step") == F.col("b_step"))
        was = was.select(F.col("b_id").alias("i_id"), "c_id", F.col("s_step").alias("__sent")).distinct()
        scored = scored.join(was, ["i_id", "c_id"], "left")
    else:
        scored = scored.withColumn("__sent", F.lit(None).cast("string"))
    identical = F.coalesce(F.col("i_sha1") == F.col("c_sha1"), F.lit(False))
    raw = _score(fields, d)
    raw = F.when(identical, 1.0).otherwise(F.when(F.col("__sent").isNotNull(), F.least(F.lit(1.0), raw + V.SENT_BONUS)).otherwise(raw))
    return scored.withColumn("__raw", raw).where(F.col("__raw") >= floor).select(
        F.col("i_id").alias("item_id"), F.col("c_id").alias("case_id"), F.col("c_filename").alias("filename"),
        (F.floor(F.col("__raw") * 100 + 0.5) / 100).alias("score"), identical.alias("identical"), _reasons(fields, d, identical).alias("why"),
    )


def _both(f: str) -> Column:
    return (F.col(f"i_{f}") != "") & (F.col(f"c_{f}") != "")


def _content(fields: dict[str, float]) -> Column:
    """Weight of the fields that both sides have."""
    return sum((F.when(_both(f), w).otherwise(0.0) for f, w in fields.items()), F.lit(0.0))


def _types_differ() -> Column:
    i, c = F.coalesce("i_form_type", F.lit("")), F.coalesce("c_form_type", F.lit(""))
    return (i != "") & (c != "") & (i != c)


def _reasons(fields: dict[str, float], d: dict[str, Column], identical: Column) -> Column:
    """The reasons for a score in words: file name, fields that agree, fields of weight that don't, type, step."""
    listed = lambda lead, cond: F.when(
        (_content(fields) >= V.MIN_CONTENT_WEIGHT) & (F.size(F.array_compact(F.array(*[F.when(_both(f) & cond(f, w), V.CONTENT_WORDS[f]) for f, w in fields.items()]))) > 0),
        F.concat(F.lit(lead), F.concat_ws(", ", *[F.when(_both(f) & cond(f, w), V.CONTENT_WORDS[f]) for f, w in fields.items()])),
    )
    steps = F.create_map(*[F.lit(x) for kv in V.STEP_LABELS.items() for x in kv])
    reasons = F.array_compact(F.array(
        F.when(d["fname"] >= V.SAME_NAME_FROM, "same file name").when(d["fname"] >= V.SIMILAR_NAME_FROM, "similar file name"),
        listed("same ", lambda f, w: d[f] >= V.SAME_FIELD_FROM),
        listed("different ", lambda f, w: (d[f] < V.DIFFERENT_FIELD_BELOW) & F.lit(w >= V.MIN_CONTENT_WEIGHT)),
        F.when(_types_differ(), F.when(F.col("i_form_type") == "F10", "it's an F10").otherwise("it's an F174")),
        F.concat(F.lit("was sent for "), F.coalesce(F.try_element_at(steps, F.col("__sent")), F.col("__sent"))),
    ))
    return F.when(identical, F.array(F.lit("identical to the copy on file"))).otherwise(reasons)


def _score(fields: dict[str, float], d: dict[str, Column]) -> Column:
    got = sum((F.when(_both(f), d[f] * w).otherwise(0.0) for f, w in fields.items()), F.lit(0.0))
    total = _content(fields)
    base = F.when(total < V.MIN_CONTENT_WEIGHT, d["fname"] * V.FILENAME_ONLY_SHARE).otherwise(V.FILENAME_SHARE * d["fname"] + V.CONTENT_SHARE * got / total)
    return base * F.when(_types_differ(), V.TYPE_MISMATCH_FACTOR).otherwise(1.0)


def suggest(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Default choice per item (item_id, action, case_id, review) from its two best candidates."""
    two = keep_first(candidates, ["item_id"], [F.desc("score"), F.col("filename"), F.col("case_id")], 2)
    best = two.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "filename", "case_id"))).alias("c")
    )
    joined = items.join(best, "item_id", "left")
    s1, s2 = -F.get("c", F.lit(0))["m"], -F.get("c", F.lit(1))["m"]
    first = F.get("c", F.lit(0))["case_id"]
    clear = (s1 >= V.SUGGEST_SURE) & (s2.isNull() | (F.round(s1 - s2, 10) >= V.SUGGEST_MARGIN))
    maybe = s1 >= V.SUGGEST_MAYBE
    warned = F.coalesce("warned", F.lit(False))
    return joined.select(
        "item_id",
        F.when(clear | maybe, "replace").otherwise("new").alias("action"),
        F.when(clear | maybe, first).alias("case_id"),
        F.when(F.coalesce(clear, F.lit(False)), warned).otherwise(F.coalesce(maybe, F.lit(False))).alias("review"),
    )


# ---- boxes on a page --------------------------------------------------------------------------------

def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))


#: Boxes of a page up to which all words of the page are compared with all of them.
CROWDED = 1000


def assign_words(words: DataFrame, boxes: DataFrame, pad: float, cell: float | None = None) -> DataFrame:
    """Every word goes to the box it sits in, or the nearest within `pad`; the smaller box wins a tie, then the first. Distances and areas
    are compared in whole billionths, so equal ones tie however they were summed.

    words: page, word_no, word, cx, cy; boxes: page, box, x0, y0, x1, y1. Words and boxes meet by page, so each is moved once and a word's
    boxes are where it is. Only on pages of more than CROWDED boxes does a padded box list the grid cells it covers (of twice `pad`, if not
    said otherwise) and a word have one cell, so that only neighbours meet there.
    """
    words, boxes = words.dropna(subset=["page", "cx", "cy"]), boxes.dropna(subset=["page", "x0", "y0", "x1", "y1"])
    crowded = cut_lineage(boxes.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("page"), "crowded")
    if crowded.isEmpty():
        return _nearest(words, boxes, ["page"], pad)
    few = _nearest(words.join(crowded, "page", "left_anti"), boxes.join(crowded, "page", "left_anti"), ["page"], pad)
    size = max(2 * pad, 0.05) if cell is None else cell
    b = boxes.join(crowded, "page", "left_semi").withColumn("gx", F.explode(_cells(F.col("x0") - pad, F.col("x1") + pad, size)))
    b = b.withColumn("gy", F.explode(_cells(F.col("y0") - pad, F.col("y1") + pad, size)))
    w = words.join(crowded, "page", "left_semi").withColumn("gx", F.floor(F.col("cx") / size).cast("int")).withColumn("gy", F.floor(F.col("cy") / size).cast("int"))
    return few.unionByName(_nearest(w, b, ["page", "gx", "gy"], pad))


def _nearest(words: DataFrame, boxes: DataFrame, on: list[str], pad: float) -> DataFrame:
    """The nearest box of each word among those that share `on` with it."""
    dx = F.greatest(F.col("x0") - F.col("cx"), F.lit(0.0), F.col("cx") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("cy"), F.lit(0.0), F.col("cy") - F.col("y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    whole = lambda c: F.floor(c * 1e9 + 0.5)
    near = words.join(boxes.hint("merge"), on).withColumn("d", F.hypot(dx, dy)).where(F.col("d") <= pad)
    ranked = near.select("page", "word_no", "word", F.struct(whole(F.col("d")).alias("near"), whole(area).alias("area"), "box", "d").alias("r"))
    return ranked.groupBy("page", "word_no").agg(F.first("word").alias("word"), F.min("r").alias("r")).select(
        "page", "word_no", "word", F.col("r.box").alias("box"), F.col("r.d").alias("distance"))


def subtract_baseline(found: DataFrame, printed: DataFrame, block: int = 4096) -> DataFrame:
    """Words left in each box after taking out, one for one, the words printed on the blank form.

    found: page, box, word, word_no; printed: page, box, word. The earliest occurrences go first.
    """
    counts = printed.groupBy("page", "box", "word").agg(F.count("*").alias("c"))
    return subtract_counts(found, counts, ["page", "box", "word"], block)


def subtract_counts(found: DataFrame, counts: DataFrame, on: list[str], block: int | None = 4096) -> DataFrame:
    """The same with printed words already counted (c), per box or, with fewer columns in `on`, for all boxes alike.

    Without `block` the words of a page have to come from one row: a page is no more than a value, and numbered as a whole. If `found` is
    dealt out by page, its words are then not moved again.
    """
    if block is None:
        numbered = found.withColumn("__k", F.row_number().over(W.partitionBy("page", "box", "word").orderBy("word_no")))
    else:
        numbered = row_numbers(found, ["page", "box", "word"], [F.col("word_no")], F.floor(F.col("word_no") / block), "__k")
    taken = counts.select(*on, F.col("c").alias("__c"))
    return numbered.join(taken, on, "left").where(F.col("__k") > F.coalesce("__c", F.lit(0))).drop("__k", "__c")


# ---- layouts ----------------------------------------------------------------------------------------

def classify_layout(pages: DataFrame, templates: DataFrame, n_templates: int) -> DataFrame:
    """Best template per page by dot product of zero-mean unit vectors.

    pages: id, vec, hint; templates: template, vec. Templates are a fixed set (the form types); the caller states
    how many there can be, which bounds what is sent to every task.
    """
    if n_templates > 1000:
        raise ValueError("too many templates to compare each page with all of them")
    t = templates.select("template", unit_vector("vec").alias("tv"))
    packed = t.groupBy().agg(F.sort_array(F.collect_list(F.struct("template", "tv"))).alias("ts"))
    p = pages.select("id", "hint", unit_vector("vec").alias("pv"))
    joined = p.withColumn("__one", F.lit(1)).join(F.broadcast(packed.withColumn("__one", F.lit(1))), "__one")
    scores = F.transform("ts", lambda x: F.struct(cosine("pv", x["tv"]).alias("score"), x["template"].alias("template")))
    ranked = joined.select("id", "hint", scores.alias("s"))
    best = F.aggregate(
        F.col("s"), F.get("s", F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a)
    )
    hinted = F.get(F.filter("s", lambda x: x["template"] == F.col("hint")), F.lit(0))["score"]
    return ranked.select("id", "hint", best.alias("b"), hinted.alias("hint_score")).select(
        "id", F.col("b.template").alias("template"), F.col("b.score").alias("score"), "hint", "hint_score",
        F.coalesce(
            (F.col("hint") != F.col("b.template")) & (F.col("b.score") - F.col("hint_score") > 0.2)
            & (F.col("hint_score") < 0.5), F.lit(False)
        ).alias("mislabeled"),
    )

