"""Questions asked of case records: pools, facets, totals, histograms, rankings, pages of a list.

Records carry one row per case with record fields, step flags and lifecycle flags. Every report is one pass
of partial aggregation; nothing here windows over an unbounded group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .. import fixed_values as V
from ..functions import collapse, num
from .scale import is_false, is_true, keep_first, ordered_total




# ---- predicates -----------------------------------------------------------------------------------

def active() -> Column:
    return ~is_true(F.col("missing")) & ~is_true(F.col("archived")) & ~is_true(F.col("rejected"))


def parsed() -> Column:
    return active() & is_true(F.col("parsed"))


def incomplete() -> Column:
    return F.size("incomplete") > 0


def in_queue() -> Column:
    return is_true(F.col("needs_review")) | incomplete()


def awaiting() -> Column:
    return is_true(F.col("parsed")) & reduce(lambda a, b: a | b, [is_false(F.col(s)) for s in V.STEPS])


def next_step() -> Column:
    """First step known to be open, in route order; rejected first, "complete" last, null when unread."""
    first = F.coalesce(*[F.when(is_false(F.col(s)), F.lit(s)) for s in V.STEPS], F.lit("complete"))
    return F.when(is_true(F.col("rejected")), "rejected").when(is_true(F.col("parsed")), first)


def open_steps() -> Column:
    return F.array_compact(F.array(*[F.when(is_false(F.col(s)), F.lit(s)) for s in V.STEPS]))


def progress() -> Column:
    """Struct of applicable steps, done steps and the label of the next one."""
    applicable = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in V.STEPS])
    done = reduce(lambda a, b: a + b, [is_true(F.col(s)).cast("int") for s in V.STEPS])
    nxt = F.coalesce(*[F.when(is_false(F.col(s)), F.lit(V.STEP_LABELS[s])) for s in V.STEPS], F.lit(""))
    return F.struct(applicable.alias("steps"), done.alias("done"), nxt.alias("next"))


def search(columns: list[str], query: str) -> Column:
    """Every word of the query occurs somewhere in the joined lower-case columns."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    words = query.strip().lower().split()
    return reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in words], F.lit(True))


SEARCH_COLUMNS = ["filename", "recipients", "reason_category", "reason_details", "issuer", "class_year", "notes"]


def facet_predicates(selected: dict[str, str], query: str = "") -> dict[str, Column]:
    """One predicate per filter group (type, pn, step) and the text search (q)."""
    out = {"q": search(SEARCH_COLUMNS, query)}
    for group, column in (("type", "form_type"), ("pn", "pos_neg")):
        v = selected.get(group, "all")
        out[group] = F.lit(True) if v == "all" else is_true(F.col(column) == v)
    out["step"] = step_option(selected.get("step", "all"))
    return out


def step_option(v: str) -> Column:
    step = next_step()
    if v == "all":
        return F.lit(True)
    if v == "review":
        return is_true(F.col("needs_review"))
    if v == "open":
        return is_true(step.isNotNull() & ~step.isin("complete", "rejected"))
    return is_true(step == v)


def matches(selected: dict[str, str], query: str = "", skip: str = "") -> Column:
    return reduce(lambda a, b: a & b, [p for k, p in facet_predicates(selected, query).items() if k != skip], F.lit(True))


FACETS = {
    "step": ["all", "review", "open", *V.STEPS, "complete", "rejected"],
    "type": ["all", "F10", "F174"],
    "pn": ["all", "Pos", "Neg"],
}


def facet_counts(records: DataFrame, selected: dict[str, str] | None = None, query: str = "") -> DataFrame:
    """(facet, option, n): each group counted under the other groups' filters, in one pass over the cases."""
    selected = selected or {}
    base = records.where(~is_true(F.col("archived")))
    option = lambda g, v: facet_predicates({g: v})[g]
    cells = [(g, v) for g, vs in FACETS.items() for v in vs]
    counts = base.agg(*[F.count_if(matches(selected, query, g) & option(g, v)).alias(f"{g}:{v}") for g, v in cells])
    entries = F.array(*[F.struct(F.lit(g).alias("facet"), F.lit(v).alias("option"), F.col(f"`{g}:{v}`").alias("n"),
                                 F.lit(v == "all" or selected.get(g, "all") == v).alias("keep")) for g, v in cells])
    return counts.select(F.inline(entries)).where(F.col("keep") | (F.col("n") > 0)).select("facet", "option", "n")


def in_scope(scopes: str | list[str]) -> Column:
    """A case fits any of the chosen kinds of paperwork."""
    chosen = [scopes] if isinstance(scopes, str) else list(dict.fromkeys(scopes))
    if any(s not in V.SCOPES for s in chosen):
        raise ValueError(f"unknown scope in {chosen}")
    rejected = is_true(F.col("rejected"))
    pos = is_true(F.col("pos_neg") == "Pos")
    waiting = reduce(lambda a, b: a | b, [is_false(F.col(s)) for s in V.STEPS])
    one = {
        "all": F.lit(True), "negative": ~pos & ~rejected, "positive": pos & ~rejected,
        "outstanding_negative": ~pos & ~rejected & waiting, "in_progress": ~rejected & waiting, "rejected": rejected,
    }
    return reduce(lambda a, b: a | b, [one[s] for s in chosen])


def outstanding() -> Column:
    return is_true(F.col("rejected")) | reduce(lambda a, b: a | b, [is_false(F.col(s)) for s in V.STEPS])


def outcomes(counted: Column) -> Column:
    """What a case means for the party, as one text."""
    def part(label: str, c: str) -> Column:
        t = collapse(c)
        return F.when((t != "") & (t != "0"), F.concat(F.lit(f"{label}: "), t))

    pos = F.array_compact(F.array(part("CDNA", "cdna"), part("Passes", "passes")))
    neg = F.array_compact(F.array(
        part("Demerits", "demerits"), part("Tours", "tours"), part("Confinements", "confinements"),
        F.when(collapse("other") != "", collapse("other")),
    ))
    text = F.array_join(F.when(is_true(F.col("pos_neg") == "Pos"), pos).otherwise(neg), "; ")
    return (
        F.when(is_true(F.col("rejected")) | (text == ""), "")
        .when(is_true(counted), text).otherwise(F.concat(F.lit("Pending until fully signed: "), text))
    )


def export_filter(mode: str = "unlogged", pos_neg: str = "all") -> Column:
    keep = parsed()
    if mode == "unlogged":
        keep = keep & ~is_true(F.col("logged"))
    return keep if pos_neg == "all" else keep & is_true(F.col("pos_neg") == pos_neg)


# ---- totals -----------------------------------------------------------------------------------------

def kpis(records: DataFrame) -> DataFrame:
    """Overview figures. records also hold party_keys ARRAY and numeric text counts."""
    p, n = parsed(), F.size("party_keys")
    per_row = lambda c, cond: F.coalesce(F.sum(F.when(cond, num(c) * n)), F.lit(0.0))
    main = records.agg(
        F.count_if(active()).alias("active"), F.count_if(p).alias("parsed"),
        F.count_if(p & is_true(F.col("pos_neg") == "Neg")).alias("negative"),
        F.count_if(p & is_true(F.col("pos_neg") == "Pos")).alias("positive"),
        F.count_if(p & awaiting()).alias("awaiting"), F.count_if(active() & in_queue()).alias("review"),
        F.count_if(p & ~is_true(F.col("logged"))).alias("unlogged"),
        per_row("tours", p & is_true(F.col("counted"))).alias("tours"),
        per_row("confinements", p & is_true(F.col("counted"))).alias("confinements"),
        per_row("demerits", p).alias("demerits"), F.lit(1).alias("__one"),
    )
    people = records.where(p).select(F.explode("party_keys").alias("k")).agg(
        F.count_distinct("k").alias("parties"), F.lit(1).alias("__one")
    )
    return main.join(people, "__one").drop("__one")  # two one-row results


def step_completion(records: DataFrame) -> DataFrame:
    """(step, applicable, done, pct) over parsed cases."""
    one = records.where(parsed()).agg(
        *[F.count(s).alias(f"a_{s}") for s in V.STEPS], *[F.count_if(is_true(F.col(s))).alias(f"d_{s}") for s in V.STEPS]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"a_{s}").alias("applicable"), F.col(f"d_{s}").alias("done")) for s in V.STEPS])
    pct = F.when(F.col("applicable") > 0, F.round(100.0 * F.col("done") / F.col("applicable"), 4)).otherwise(0.0)
    return one.select(F.inline(rows)).withColumn("pct", pct)


def month_histogram(records: DataFrame) -> DataFrame:
    """(month, neg, pos) for the last twelve months with data, gaps filled, padded back to six months.

    Anything that is not "Pos" counts as negative here.
    """
    by = records.where(parsed() & F.col("date_iso").isNotNull()).groupBy(
        F.trunc("date_iso", "month").alias("month")
    ).agg(F.count_if(~is_true(F.col("pos_neg") == "Pos")).alias("neg"), F.count_if(is_true(F.col("pos_neg") == "Pos")).alias("pos"))
    span = by.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where(F.col("hi").isNotNull())
    start = F.least(F.greatest(F.col("lo"), F.add_months("hi", -11)), F.add_months("hi", -5))
    spine = span.select(F.explode(F.sequence(start, F.col("hi"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(by, "month", "left").select(
        "month", F.coalesce("neg", F.lit(0)).alias("neg"), F.coalesce("pos", F.lit(0)).alias("pos")
    )


def top_reasons(records: DataFrame, n: int = 7) -> DataFrame:
    """Most frequent reasons; blank is "Unspecified"; ties by name."""
    reason = F.trim(F.when(F.coalesce("reason_category", F.lit("")) == "", "Unspecified").otherwise(F.col("reason_category")))
    pos = is_true(F.col("pos_neg") == "Pos")
    return records.where(parsed()).groupBy(reason.alias("reason")).agg(
        F.count_if(~pos).alias("neg"), F.count_if(pos).alias("pos"), F.count("*").alias("total")
    ).orderBy(F.desc("total"), "reason").limit(n)


def party_index(rows: DataFrame) -> DataFrame:
    """One line per party from (case, party) rows: key, name, ord, class_year, date_iso, pos_neg, counts, counted."""
    key = F.when(F.coalesce("key", F.lit("")) != "", F.col("key")).otherwise(F.col("name"))
    pos = is_true(F.col("pos_neg") == "Pos")
    counted = is_true(F.col("counted"))
    return rows.groupBy(key.alias("key")).agg(
        F.min_by("name", "ord").alias("name"), F.count("*").alias("cases"), F.count_if(~pos).alias("neg"),
        F.count_if(pos).alias("pos"), F.sum(num("demerits")).alias("demerits"),
        F.sum(F.when(counted, num("tours")).otherwise(0.0)).alias("tours"),
        F.sum(F.when(counted, num("confinements")).otherwise(0.0)).alias("confinements"),
        F.max("date_iso").alias("last_date"),
        F.coalesce(F.min_by("class_year", F.when(F.coalesce("class_year", F.lit("")) != "", F.col("ord"))), F.lit("")).alias("class_year"),
    )


def parties(rows: DataFrame) -> DataFrame:
    """Parties with active cases: the first spelling by `ord` wins."""
    return rows.where(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(
        F.min_by("name", "ord").alias("name"), F.count("*").alias("cases"),
        F.coalesce(F.min_by("class_year", F.when(F.coalesce("class_year", F.lit("")) != "", F.col("ord"))), F.lit("")).alias("class_year"),
    )


def known_names(rows: DataFrame) -> DataFrame:
    """Every known party: the last spelling by `ord` wins."""
    return rows.where(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(F.max_by("name", "ord").alias("name"))


def scope_counts(rows: DataFrame) -> DataFrame:
    """Per party and kind of paperwork: cases in it, and those still outstanding."""
    aggs = []
    for s in V.SCOPES:
        aggs += [F.count_if(in_scope(s)).alias(s), F.count_if(in_scope(s) & outstanding()).alias(f"{s}_open")]
    return rows.where(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(*aggs)


def digest_totals(rows: DataFrame) -> DataFrame:
    rejected = is_true(F.col("rejected"))
    neg = ~is_true(F.col("pos_neg") == "Pos") & ~rejected
    counted = neg & is_true(F.col("counted"))
    total = lambda c, cond: F.sum(F.when(cond, num(c)).otherwise(0.0)).alias(c)
    return rows.where(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(
        F.count("*").alias("forms"), F.count_if(neg).alias("neg"), F.count_if(~neg & ~rejected).alias("pos"),
        F.count_if(rejected).alias("rejected"), total("demerits", neg), total("tours", counted), total("confinements", counted),
    )


def name_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def badges(records: DataFrame) -> DataFrame:
    """Counts shown on the navigation."""
    return records.agg(
        F.count_if(active()).alias("paperwork"), F.count_if(active() & in_queue()).alias("review"),
        F.count_if(parsed() & ~is_true(F.col("logged"))).alias("export"), F.count_if(is_true(F.col("archived"))).alias("archive"),
        *[F.count_if(parsed() & is_false(F.col(s))).alias(f"bulk_{s}") for s in V.BULK_STEPS],
    )


# ---- order, pages, last n ---------------------------------------------------------------------------

def snapshot_order(records: DataFrame) -> DataFrame:
    key = F.concat(F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), F.lit("")), F.lower("filename"))
    return records.orderBy(key.desc())


def sort_list(records: DataFrame, key: str = "date", descending: bool = False) -> DataFrame:
    value = {
        "date": F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), F.lit("")),
        "who": F.lower(F.when(F.coalesce("recipients", F.lit("")) != "", F.col("recipients")).otherwise(F.col("filename"))),
        "type": F.coalesce("form_type", F.lit("")), "issuer": F.lower(F.coalesce("issuer", F.lit(""))),
    }[key]
    return records.orderBy(value.desc() if descending else value.asc(), "filename")


def rank_parties(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc("neg"), F.desc("cases"), "name")


def rank_balances(b: DataFrame, owing_only: bool = True) -> DataFrame:
    left = F.col("tours_left") + F.col("confinements_left")
    return (b.where(left > 0) if owing_only else b).orderBy(left.desc(), "name")


def review_queue(records: DataFrame) -> DataFrame:
    """Active cases that need review (0), then incomplete ones (1), then the finished reviews (2)."""
    review, unfinished = is_true(F.col("needs_review")), incomplete()
    rank = F.when(review, 0).when(unfinished, 1).when(is_true(F.col("flagged")) & is_true(F.col("reviewed")), 2)
    return records.where(active()).withColumn("queue", rank).where(F.col("queue").isNotNull())


def packet_index(records: DataFrame, pages: str = "page_count") -> DataFrame:
    """Start page of each case in a combined print, after the index sheets."""
    day = F.coalesce("date_iso", F.lit("9999-12-31").cast("date"))
    src = records.withColumn("__day", day)
    run = ordered_total(src, [F.col("__day"), F.col("filename")], F.col(pages), "before", exclusive=True)
    sheets = records.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / V.PACKET_LINES)).alias("sheets"), F.lit(1).alias("__one"))
    joined = run.withColumn("__one", F.lit(1)).join(F.broadcast(sheets), "__one")  # one row
    return joined.withColumn("start_page", F.col("before") + 1 + F.col("sheets")).drop("__one", "__day", "before", "sheets")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return keep_first(df, keys, order, n)


def trim_history(history: Column, keep: int = V.HISTORY_KEEP) -> Column:
    """The last entries of a bounded log column."""
    return F.when(F.size(history) > keep, F.slice(history, F.lit(-keep), F.lit(keep))).otherwise(history)
