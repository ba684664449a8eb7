"""Assessed against settled: the settlement log, balances, cutoffs and oldest-first allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SettlementLayout
from ..fixed_values import SETTLEMENT_REQUIRED
from ..functions import collapse, norm_text, num, parse_date, serial_to_date
from .scale import is_true, running_total, spread

KINDS = ("tours", "confinements")


def read_settlements(cells: DataFrame, layout: SettlementLayout = SettlementLayout()) -> DataFrame:
    """Settlement rows from sheets of cells (sheet, row_no, cells).

    The header is the configured row, else the first of the top rows holding all required headings. Every
    row with anything in it comes back, with `skip_reason` null on the usable ones. A sheet without such a row
    gives all its rows, with a `skip_reason` that names the sheet.
    """
    want = {k: v for k, v in layout.headings.items() if v}
    norm = F.transform("cells", norm_text)
    at = {k: F.array_position(norm, F.lit(_norm(v))).cast("int") - 1 for k, v in want.items()}
    found = F.lit(True)
    for k in SETTLEMENT_REQUIRED:
        found = found & (at[k] >= 0)
    top = cells.where((F.col("row_no") <= layout.search_rows) | (F.col("row_no") == layout.header_row)).where(found)
    pick = F.struct(
        F.when(F.col("row_no") == layout.header_row, 0).otherwise(1).alias("rank"), F.col("row_no").alias("header_row"),
        *[at[k].alias(k) for k in want],
    )
    headers = top.groupBy("sheet").agg(F.min(pick).alias("h"))
    headers = headers.select(F.col("sheet").alias("__sheet"), "h")
    body = cells.join(headers, F.col("sheet").eqNullSafe(F.col("__sheet")), "left")
    # few bytes, much work a row; the join may have dealt rows by sheet
    body = spread(body.where(F.col("h").isNull() | (F.col("row_no") > F.col("h.header_row"))), "sheet", "row_no")
    headless = F.col("h").isNull() & (collapse(F.concat_ws(" ", "cells")) != "")
    value = lambda k: collapse(F.when(F.col(f"h.{k}") >= 0, F.get("cells", F.col(f"h.{k}")))) if k in want else F.lit("")
    rows = body.select("sheet", "row_no", *[value(k).alias(k) for k in layout.headings], headless.alias("headless"))
    rows = rows.where((F.concat_ws("", *layout.headings) != "") | F.col("headless"))
    rows = rows.withColumns({"word": norm_text("type"), "units": num("amount")})
    kind = F.when(F.contains("word", F.lit(_norm(layout.tour_word))), "tour").when(
        F.contains("word", F.lit(_norm(layout.confinement_word))), "confinement"
    )
    amount = F.col("units")
    reason = F.when(F.col("headless"), F.concat(F.lit("no_headings: "), F.coalesce("sheet", F.lit("")))).when(F.col("cadet") == "", "unnamed").when(kind.isNull(), "unknown_type").when(~(amount > 0), "bad_amount")
    day = F.when(F.col("date").rlike(r"^\d+(\.\d+)?$"), serial_to_date("date")).otherwise(parse_date("date"))
    return rows.select(
        "sheet", "row_no", day.alias("settled_on"), "cadet", kind.alias("kind"), amount.alias("units"),
        "supervisor", "notes", F.col("date").alias("raw_date"), F.col("type").alias("raw_type"),
        F.col("amount").alias("raw_amount"), reason.alias("skip_reason"),
    )


def _norm(s: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))


def balances(assessments: DataFrame, settlements: DataFrame, before: str | None = None) -> DataFrame:
    """Assigned, served, left and over per party.

    assessments: party, name, ord, class_year, counted, pos_neg, date_iso, tours, confinements (numbers).
    settlements: party, name, kind (tour/confinement), units. Only counted, not positive cases dated strictly
    before the cutoff are assigned; everything settled counts. Both sides shrink to one row per party in a
    partial aggregate before they meet.
    """
    due = is_true(F.col("counted")) & (F.coalesce("pos_neg", F.lit("")) != "Pos")
    if before:
        due = due & is_true(F.col("date_iso") < F.lit(before).cast("date"))
    assigned = assessments.groupBy("party").agg(
        F.min_by("name", "ord").alias("name"),
        F.count("*").alias("forms"),
        F.min_by("class_year", F.when(F.coalesce("class_year", F.lit("")) != "", F.col("ord"))).alias("class_year"),
        *[F.sum(F.when(due, F.col(k)).otherwise(0.0)).alias(f"{k}_assigned") for k in KINDS],
    )
    served = settlements.groupBy("party").agg(
        F.min("name").alias("log_name"),
        *[F.sum(F.when(F.col("kind") == k[:-1], F.col("units")).otherwise(0.0)).alias(f"{k}_served") for k in KINDS],
    )
    both = assigned.join(served, "party", "full_outer")
    a = lambda k: F.coalesce(f"{k}_assigned", F.lit(0.0))
    s = lambda k: F.coalesce(f"{k}_served", F.lit(0.0))
    cols = []
    for k in KINDS:
        cols += [
            a(k).alias(f"{k}_assigned"), s(k).alias(f"{k}_served"),
            F.greatest(F.lit(0.0), a(k) - s(k)).alias(f"{k}_left"),
            F.greatest(F.lit(0.0), s(k) - a(k)).alias(f"{k}_over"),
        ]
    return both.select(
        "party", F.coalesce("name", "log_name").alias("name"), F.coalesce("class_year", F.lit("")).alias("class_year"),
        F.col("forms").isNotNull().alias("on_file"), F.coalesce("forms", F.lit(0)).alias("forms"), *cols,
    )


def owes(b: DataFrame) -> Column:
    return (F.col("tours_left") > 0) | (F.col("confinements_left") > 0)


def totals(b: DataFrame) -> DataFrame:
    """Grand totals and how many still owe."""
    return b.agg(
        *[F.sum(f"{k}_{w}").alias(f"{k}_{w}") for k in KINDS for w in ("assigned", "served", "left")],
        F.count_if(owes(b)).alias("owing"),
    )


def unmatched(b: DataFrame) -> DataFrame:
    """Names settled for that have no case."""
    return b.where(~F.col("on_file")).select("party", "name")


def allocate_oldest_first(assessments: DataFrame, settlements: DataFrame) -> DataFrame:
    """What is left of each assessment when settlements pay the earliest first.

    assessments: party, kind, case_id, date_iso, amount (undated last). settlements: party, kind, units.
    """
    paid = settlements.groupBy("party", "kind").agg(F.sum("units").alias("served"))
    day = F.coalesce("date_iso", F.lit("9999-12-31").cast("date"))
    src = assessments.withColumn("__day", day)
    cum = running_total(
        src, ["party", "kind"], [F.col("__day"), F.col("case_id")], F.col("__day"), F.col("amount"), "cum"
    )
    joined = cum.join(paid, ["party", "kind"], "left")
    served = F.coalesce("served", F.lit(0.0))
    left = F.least(F.col("amount"), F.greatest(F.lit(0.0), F.col("cum") - served))
    return joined.select("party", "kind", "case_id", "date_iso", "amount", left.alias("left"))


def settlement_kpis(rows: DataFrame, layout: SettlementLayout = SettlementLayout()) -> DataFrame:
    """Sums by type word (case-insensitive, anywhere in the type) and the number of amounts."""
    amount = F.col("raw_amount").try_cast("double")
    hit = lambda w: F.contains(F.lower("raw_type"), F.lit(w.lower()))
    return rows.agg(
        F.coalesce(F.sum(F.when(hit(layout.tour_word), amount)), F.lit(0.0)).alias("tours_served"),
        F.coalesce(F.sum(F.when(hit(layout.confinement_word), amount)), F.lit(0.0)).alias("confinements_served"),
        F.count(amount).alias("sessions"),
    )


def status(b: DataFrame) -> DataFrame:
    owing = F.col("tours_left") + F.col("confinements_left") > 0
    return b.withColumn("status", F.when(owing, "Outstanding Balance").otherwise("Clear"))


def balance_kpis(b: DataFrame) -> DataFrame:
    return status(b).agg(
        F.count("*").alias("parties"), F.sum("forms").alias("reports"),
        F.sum("tours_left").alias("remaining_tours"), F.sum("confinements_left").alias("remaining_confinements"),
        F.count_if(F.col("status") == "Outstanding Balance").alias("outstanding"),
    )


def reports_per_party(rows: DataFrame, party: str) -> DataFrame:
    named = rows.where(F.coalesce(F.col(party), F.lit("")) != "")
    return named.groupBy(F.col(party).alias("party")).agg(F.count("*").alias("reports"))


def passthrough(raw: DataFrame, spelling: DataFrame) -> DataFrame:
    """Every settlement row as written, with only the name respelled where it is known.

    raw: row_no, cadet, ...; spelling: cadet, canonical.
    """
    look = spelling.select(F.col("cadet").alias("__c"), "canonical")
    return raw.join(look, raw["cadet"] == F.col("__c"), "left").drop("__c").withColumn(
        "cadet", F.coalesce("canonical", collapse("cadet"))
    ).drop("canonical")
