"""Digests: what one party is told about their cases, as rows of lines, and which files go along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import collapse, display_date, fill_template, first_name, last_name
from ..session import cut_lineage
from .reports import digest_totals, outcomes
from .scale import is_false, is_true


def personalise(df: DataFrame, template: str, name: str, out: str) -> DataFrame:
    named = df.withColumn("__f", first_name(name)).withColumn("__l", last_name(name))
    return named.withColumn(out, fill_template(F.lit(template), F.col(name), F.col("__f"), F.col("__l"))).drop("__f", "__l")


def _step_list(done: bool) -> Column:
    test = (lambda s: is_true(F.col(s))) if done else (lambda s: is_false(F.col(s)))
    return F.array_join(F.array_compact(F.array(*[F.when(test(s), F.lit(V.STEP_LABELS[s])) for s in V.STEPS])), ", ")


def case_lines(rows: DataFrame) -> DataFrame:
    """Digest text of each (party, case) row: head, status, steps and outcomes."""
    rejected = is_true(F.col("rejected"))
    form = F.when(F.col("form_type") == "F174", "AF 174").when(F.col("form_type") == "F10", "Form 10").otherwise("Form")
    kind = F.when(F.col("pos_neg") == "Pos", ", Positive").when(F.col("pos_neg") == "Neg", ", Negative").otherwise("")
    reason = collapse("reason_category")
    head = F.concat_ws(" - ", display_date("date_iso"), F.concat(form, kind), F.when(reason != "", reason))
    nxt = F.coalesce(*[F.when(is_false(F.col(s)), F.lit(V.STEP_LABELS[s])) for s in V.STEPS], F.lit(""))
    status = F.when(rejected, "Rejected, so nothing from this form counts").when(
        nxt != "", F.concat(F.lit("Waiting on: "), nxt)
    ).otherwise("Fully processed")
    done, todo = _step_list(True), _step_list(False)
    steps = F.when(rejected, "").otherwise(F.concat_ws(
        " ", F.when(done != "", F.concat(F.lit("Done: "), done, F.lit("."))),
        F.when(todo != "", F.concat(F.lit("Still to do: "), todo, F.lit("."))),
    ))
    return rows.select("key", "case_id", "date_iso", head.alias("head"), status.alias("status"), steps.alias("steps"),
                       outcomes(F.col("counted")).alias("outcomes"))


def totals_line(t: DataFrame) -> DataFrame:
    """The totals sentence per party from `digest_totals`."""
    whole = lambda c: F.col(c).cast("bigint")
    plural = lambda c, w: F.when(whole(c) > 0, F.concat(whole(c).cast("string"), F.lit(f" {w}"), F.when(whole(c) == 1, "").otherwise("s")))
    some = lambda c, w: F.when(whole(c) > 0, F.concat(whole(c).cast("string"), F.lit(f" {w}")))
    kinds = F.concat_ws(", ", some("neg", "negative"), some("pos", "positive"), some("rejected", "rejected"))
    sanctions = F.concat_ws(", ", plural("demerits", "demerit"), plural("tours", "tour"), plural("confinements", "confinement"))
    line = F.concat(
        F.lit("Totals: "), plural("forms", "form"), F.when(kinds != "", F.concat(F.lit(" ("), kinds, F.lit(")"))).otherwise(""),
        F.when(sanctions != "", F.concat(F.lit("; "), sanctions)).otherwise(""), F.lit("."),
    )
    return t.select("key", line.alias("totals"))


def balance_lines(b: DataFrame, detail: bool = True) -> DataFrame:
    """(key, kind, line) for what a party still has to serve; kinds with nothing assigned are left out."""
    shown = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))
    out = None
    for k, label in (("tours", "Tours"), ("confinements", "Confinements")):
        a, s, l = (f"{k}_{x}" for x in ("assigned", "served", "left"))
        open_tail = F.when(F.col(s) > 0, F.concat(F.lit(" ("), shown(s), F.lit(" served of "), shown(a), F.lit(")"))).otherwise("") if detail else F.lit("")
        done_tail = F.concat(F.lit(" (all "), shown(a), F.lit(" served)")) if detail else F.lit("")
        line = F.when(F.col(l) > 0, F.concat(F.lit(f"{label}: "), shown(l), F.lit(" left to serve"), open_tail)).otherwise(
            F.concat(F.lit(f"{label}: none left to serve"), done_tail)
        )
        part = b.where((F.col(a) > 0) | (F.col(l) > 0)).select(F.col("party").alias("key"), F.lit(k).alias("kind"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def digest_rows(rows: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """All digest lines (key, section, ord, line), one row per line: a party with very many cases stays many rows."""
    c = case_lines(rows)
    body = F.array_compact(F.array(
        F.concat(F.lit("* "), F.col("head")), F.concat(F.lit("    "), F.col("status")),
        F.when(F.col("steps") != "", F.concat(F.lit("    "), F.col("steps"))),
        F.when(F.col("outcomes") != "", F.concat(F.lit("    Rewards / sanctions: "), F.col("outcomes"))),
    ))
    order = F.concat_ws("|", F.date_format(F.coalesce("date_iso", F.lit("0001-01-01").cast("date")), "yyyy-MM-dd"), F.col("case_id").cast("string"))
    lines = c.select("key", F.lit(1).alias("section"), order.alias("of"), F.posexplode(body).alias("ord", "line"))
    tail = totals_line(digest_totals(rows)).select("key", F.lit(3).alias("section"), F.lit("").alias("of"), F.lit(0).alias("ord"), F.col("totals").alias("line"))
    out = lines.unionByName(tail)
    if balances is not None:
        mid = balance_lines(balances).select("key", F.lit(2).alias("section"), F.lit("").alias("of"), F.when(F.col("kind") == "tours", 0).otherwise(1).alias("ord"), "line")
        out = out.unionByName(mid)
    return out


def capped_pick(
    items: DataFrame, max_files: int = V.ATTACH_MAX_FILES, max_bytes: int = V.ATTACH_MAX_BYTES, salts: int = 16,
    checkpoint_every: int = 5,
) -> DataFrame:
    """Greedy pick per party in order: at most max_files items and max_bytes in all; what does not fit is skipped
    and a later, smaller item may still fit. items: party, ord, item, size. Returns (party, ord, item, size, n).

    A party whose items fit together takes them all. For the others round n finds the first item after the last
    pick, by ord and then item, that still fits, so max_files rounds finish; each round is a minimum, reduced per salt first, and never
    gathers a party's items in one task.
    """
    sized = items.groupBy("party").agg(F.count("*").alias("__n"), F.sum("size").alias("__b"))
    easy = (F.col("__n") <= max_files) & (F.col("__b") <= max_bytes)
    all_fit = items.join(sized.where(easy).select("party"), "party", "left_semi").select("party", "ord", "item", "size")
    crowded = sized.where(~easy).select("party")
    pool = items.where(F.col("size") <= max_bytes).join(crowded, "party", "left_semi").withColumn(
        "__salt", F.pmod(F.xxhash64("item"), F.lit(salts).cast("bigint"))
    )
    pool = cut_lineage(pool.repartition("party", "__salt"))
    none = F.lit(None)
    pick = "struct<ord:%s,item:%s,size:bigint>" % (dict(items.dtypes)["ord"], dict(items.dtypes)["item"])
    state = crowded.select("party", F.lit(0).cast("bigint").alias("used"), none.cast(dict(items.dtypes)["ord"]).alias("last"), none.cast(dict(items.dtypes)["item"]).alias("last_item"),
                           F.array().cast(f"array<{pick}>").alias("picks"), F.lit(True).alias("open"))
    chosen = F.struct(F.col("p.ord").alias("ord"), F.col("p.item").alias("item"), F.col("p.size").cast("bigint").alias("size"))
    for n in range(max_files):
        spread = state.where("open").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        seen = spread.join(pool, ["party", "__salt"]).where(
            (F.col("last").isNull() | (F.col("ord") > F.col("last")) | ((F.col("ord") == F.col("last")) & (F.col("item") > F.col("last_item")))) & (F.col("used") + F.col("size") <= max_bytes)
        )
        found = seen.groupBy("party").agg(F.min(F.struct("ord", "item", "size")).alias("p"))
        step = state.join(found, "party", "left")
        state = step.select(
            "party", (F.col("used") + F.coalesce("p.size", F.lit(0))).alias("used"), F.coalesce("p.ord", "last").alias("last"), F.coalesce("p.item", "last_item").alias("last_item"),
            F.when(F.col("p").isNotNull(), F.array_append("picks", chosen)).otherwise(F.col("picks")).alias("picks"),
            F.col("p").isNotNull().alias("open"),
        )
        if (n + 1) % checkpoint_every == 0 or n == max_files - 1:
            state = cut_lineage(state)
    return all_fit.unionByName(state.select("party", F.explode("picks").alias("x")).select("party", "x.ord", "x.item", "x.size"))


def circuit_breaker(events: DataFrame, limit: int = V.AUTO_MAX) -> DataFrame:
    """(round, parties, held): more parties than the limit in one round holds the round."""
    return events.groupBy("round").agg(F.count_distinct("party").alias("parties")).withColumn("held", F.col("parties") > limit)


def debounce(events: DataFrame, gap: str = f"{V.DEBOUNCE_SECONDS} seconds") -> DataFrame:
    """One row per party and burst of changes (party, started, ended, changes); batch or stream with a watermark."""
    burst = F.session_window("ts", gap)
    return events.groupBy(burst.alias("w"), "party").agg(F.count("*").alias("changes")).select(
        "party", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes"
    )
