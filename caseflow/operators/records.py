"""One record per case from its slots, edits and file name; output rows; review issues.

A case row carries its slots as a map (at most a few dozen entries), so all of this is projection:
no shuffle, whatever the number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..config import Settings
from ..functions import (
    collapse, form_name_to_display, month_label, name_key, other_text, parse_class_year, parse_date,
    sanction_count, single_name, split_names,
)
from .scale import is_false, is_true

SLOT_TYPE = (
    "map<string, struct<value_text:string, ftype:string, filled:boolean, source:string, located:boolean, "
    "within_tolerance:boolean, source_widget:boolean, page:int>>"
)


def nest_slots(slots: DataFrame) -> DataFrame:
    """Slot rows -> one map per case (bounded by the number of boxes on a form)."""
    entry = F.struct(
        "value_text", "ftype", "filled", "source", "located", "within_tolerance", "source_widget", "page"
    )
    return slots.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", entry))).alias("slots"))


def slot(key: str) -> Column:
    return F.try_element_at(F.col("slots"), F.lit(key))


def field(key: str) -> Column:
    """Effective text of a slot: a typed correction wins over what was read."""
    return F.coalesce(F.try_element_at(F.col("field_overrides"), F.lit(key)), slot(key)["value_text"], F.lit(""))


def override(key: str) -> Column:
    return F.try_element_at(F.col("overrides"), F.lit(key))


def effective_fields(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Effective fields as columns."""
    return cases.select("case_id", *[field(k).alias(k) for k in keys])


def overlay(auto: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Overrides over detected values; also the sorted list of overridden keys."""
    values = {k: F.coalesce(override(k), c) for k, c in auto.items()}
    edited = F.array_sort(F.array_compact(F.array(*[F.when(override(k).isNotNull(), F.lit(k)) for k in auto])))
    return values, edited


def _is_filled(key: str) -> Column:
    return ~collapse(field(key)).isin("", "False") | is_true(slot(key)["filled"])


def step_flag(step: str, form_type: Column, settings: Settings) -> Column:
    """True/false from the mapped slots; null when the form type has no such slot."""
    out = F.lit(None).cast("boolean")
    for ft in V.STEP_SLOTS:
        keys = settings.step_slots(ft).get(step, [])
        if keys:
            done = _is_filled(keys[0])
            for k in keys[1:]:
                done = done | _is_filled(k)
            out = F.when(form_type == ft, done).otherwise(out)
    return out


def complete(flags: list[Column]) -> Column:
    some, none_open = F.lit(False), F.lit(True)
    for f in flags:
        some = some | is_true(f)
        none_open = none_open & ~is_false(f)
    return some & none_open


def derive(cases: DataFrame, settings: Settings = Settings(), roster: DataFrame | None = None) -> DataFrame:
    """Records from case rows (case_id, filename, slots, form_type, mode, overrides, field_overrides,
    file_pos_neg, file_reason, rejected, archived)."""
    ft = F.coalesce(override("form_type"), F.col("form_type"), F.lit(""))
    base = cases.withColumns({
        "__ft": ft, "__who": single_name(field("recipient_name")), "__year": parse_class_year(field("class_year")),
        "__issuer": form_name_to_display(field("issuer")), "__grade": collapse(field("issuer_grade")),
    })
    if roster is not None:
        look = roster.select(F.col("name_key").alias("__k"), F.col("class_year").alias("__known"))
        base = base.join(look, name_key("__who") == F.col("__k"), "left").drop("__k")
    else:
        base = base.withColumn("__known", F.lit(None).cast("string"))
    ft = F.col("__ft")

    def first_filled(keys: list[str]) -> Column:
        return F.coalesce(*[F.when(collapse(field(k)) != "", field(k)) for k in keys], F.lit(""))

    base = base.withColumn(
        "__raw_date",
        F.when(ft == "F10", first_filled(V.DATE_SLOTS["F10"])).otherwise(first_filled(V.DATE_SLOTS["other"])),
    )
    f174 = ft == "F174"
    reason = F.when(collapse(field("reason")) != "", collapse(field("reason"))).otherwise(collapse(field("narrative")))
    issuer, grade = F.col("__issuer"), F.col("__grade")
    graded = F.when(
        (grade != "") & (issuer != "") & ~F.lower(issuer).startswith(F.lower(grade)), F.concat_ws(" ", grade, issuer)
    ).otherwise(issuer)
    base = base.withColumns({"__loss": other_text(field("loss_of_pass")), "__pov": other_text(field("pov_priv"))})
    loss, pov = F.col("__loss"), F.col("__pov")
    other = F.when(ft == "F10", F.concat_ws(
        "; ", F.when(loss != "", F.concat(F.lit("Loss of pass: "), loss)),
        F.when(pov != "", F.concat(F.lit("POV revoked: "), pov)),
    )).otherwise("")
    scanned = F.col("mode") == "raster"
    auto = {
        "recipients": F.col("__who"),
        "form_type": ft,
        "pos_neg": F.coalesce(F.col("file_pos_neg"), F.lit("")),
        "date": F.coalesce(F.date_format(parse_date("__raw_date"), "yyyy-MM-dd"), collapse("__raw_date")),
        "class_year": F.when(F.col("__year") != "", F.col("__year")).otherwise(F.coalesce("__known", F.lit(""))),
        "squadron": collapse(field("squadron")),
        "reason_category": F.coalesce(F.col("file_reason"), F.lit("")),
        "reason_details": F.when(f174, reason).otherwise(collapse(field("narrative"))),
        "issuer": F.when(f174, collapse(field("issuer"))).otherwise(graded),
        "cdna": F.lit(""),
        "passes": F.lit(""),
        **{k: F.when(ft == "F10", sanction_count(field(k), slot(k)["source"], scanned)).otherwise("")
           for k in V.SANCTION_FIELDS},
        "other": other,
        **{s: step_flag(s, ft, settings).cast("string") for s in V.STEPS},
    }
    values, edited = overlay(auto)
    rec = base.select(
        "case_id", "filename",
        *[values[k].alias(k) for k in V.RECORD_FIELDS],
        *[values[s].try_cast("boolean").alias(s) for s in V.STEPS],
        F.coalesce("rejected", F.lit(False)).alias("rejected"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.when(override("recipients").isNotNull(), split_names(override("recipients")))
        .when(collapse("__who") != "", F.array(F.col("__who")))
        .otherwise(F.array().cast("array<string>")).alias("recipient_list"),
        edited.alias("overridden"),
    )
    return (
        rec.withColumn("date_iso", parse_date("date"))
        .withColumn("complete", complete([F.col(s) for s in V.STEPS]))
        .withColumn("counted", F.col("complete") & ~F.col("rejected") & ~F.col("archived"))
    )


def manual_applies(form_type: Column, pos_neg: Column) -> Column:
    return (form_type == "F10") & (pos_neg == "Pos")


def missing_manual(form_type: Column, pos_neg: Column, values: dict[str, Column]) -> Column:
    """Labels of hand-entered values a positive F10 still lacks."""
    blanks = F.array_compact(F.array(
        *[F.when(collapse(values[k]) == "", F.lit(V.MANUAL_LABELS[k])) for k in V.MANUAL_FIELDS]
    ))
    return F.when(is_true(manual_applies(form_type, pos_neg)), blanks).otherwise(F.array().cast("array<string>"))


def output_rows(records: DataFrame, settings: Settings = Settings(), roster: DataFrame | None = None) -> DataFrame:
    """One 15-column row per party; a case without a party gives one row with a blank name."""
    pn = F.coalesce(F.col("pos_neg"), F.lit(""))
    label = F.when(pn == "Pos", settings.pos_label).when(pn == "Neg", settings.neg_label).otherwise(pn)
    ft_label = F.coalesce(F.col("form_type"), F.lit(""))
    for k, v in settings.form_type_labels.items():
        ft_label = F.when(F.col("form_type") == k, v).otherwise(ft_label)
    names = F.when(F.size("recipient_list") > 0, F.col("recipient_list")).otherwise(F.array(F.lit("")))
    rows = records.withColumn("__n", F.size(names)).select("*", F.posexplode(names).alias("pos", "recipient"))
    if roster is not None:
        look = roster.select(F.col("name_key").alias("__k"), F.col("class_year").alias("__known"))
        rows = rows.join(look, name_key("recipient") == F.col("__k"), "left").drop("__k")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("string"))
    years = F.transform(F.split(F.coalesce("class_year", F.lit("")), ","), collapse)
    known = F.coalesce("__known", F.lit(""))
    listed = F.get(years, F.col("pos"))
    year = (
        F.when(F.col("__n") == 1, collapse("class_year"))
        .when(F.size(years) == F.col("__n"), F.when(listed != "", listed).otherwise(known))
        .otherwise(known)
    )
    manual = is_true(manual_applies(F.col("form_type"), pn))
    f10 = F.col("form_type") == "F10"
    cells = [
        F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), F.col("date")), year, ft_label, F.col("reason_category"),
        F.col("reason_details"), month_label("date_iso", settings.month_format), F.col("recipient"), F.col("issuer"),
        label, *[F.when(manual, F.col(k)) for k in V.MANUAL_FIELDS],
        *[F.when(f10, F.col(k)) for k in V.SANCTION_FIELDS], F.col("other"),
    ]
    return rows.select("case_id", "pos", *[collapse(c).alias(n) for c, n in zip(cells, V.OUTPUT_COLUMNS)])


def slot_result(evidence: DataFrame) -> DataFrame:
    """Value, filled and source of a slot from a form field, flattened text or ink."""
    sig, box, txt = (F.col("ftype") == t for t in ("Signature", "CheckBox", "Text"))
    words = F.filter(F.split(F.coalesce("flat", F.lit("")), " "), lambda t: ~F.lower(t).isin("sign"))
    flat = F.when(sig, F.array_join(words, " ")).otherwise(F.coalesce("flat", F.lit("")))
    by_field = F.coalesce("field_value", F.lit("")) != ""
    ink = F.when(box, (F.col("ink") > V.INK_CHECKBOX) & (F.col("ink_px") >= V.INK_CHECKBOX_PX)).otherwise(
        (F.col("ink") > V.INK_OTHER) & (F.col("ink_px") >= V.INK_OTHER_PX)
    )
    out = evidence.withColumn("__flat", flat).withColumn("__ink", is_true(ink))
    by_text = ~by_field & (F.col("__flat") != "")
    box_ink = box & ~by_field & ~by_text & F.col("__ink")
    value = (
        F.when(by_field, F.col("field_value")).when(by_text & box, "true").when(by_text, F.col("__flat"))
        .when(box_ink, "true").otherwise("")
    )
    base = F.when(by_field, "field").when(by_text, "text").when(box_ink, "ink")
    digital, annot = is_true(F.col("digital")), is_true(F.col("has_annot"))
    text_ink = txt & (value == "") & F.col("__ink")
    filled = (value != "") | digital | annot | (sig & F.col("__ink")) | text_ink
    source = (
        F.when(sig & digital, "digital").when(sig & annot, F.coalesce(base, F.lit("annotation")))
        .when(sig & F.col("__ink"), F.coalesce(base, F.lit("ink"))).when(text_ink, "ink").otherwise(base)
    )
    return out.select(
        *evidence.columns, value.alias("value"), filled.alias("filled"), F.when(filled, source).alias("slot_source")
    )


def read_mode(slots: DataFrame) -> DataFrame:
    """fields, text or raster per case (case_id, source_widget, source, value)."""
    by_text = is_true((F.col("source") == "text") & (F.col("value") != ""))
    return slots.groupBy("case_id").agg(
        F.when(F.count_if(is_true(F.col("source_widget"))) >= 0.5 * F.count("*"), "fields")
        .when(F.bool_or(by_text), "text").otherwise("raster").alias("mode")
    )


def issue_rules(settings: Settings = Settings()) -> list[tuple[str, str, Column, Column]]:
    """(code, level, condition, detail) in display order."""
    values = F.map_values("slots")
    count = lambda test: F.size(F.filter(values, test))
    mapped = F.coalesce("page_map", F.array().cast("array<int>"))
    unplaced_page = F.exists(mapped, lambda j: j < 0)
    scored = F.filter(
        F.arrays_zip(F.col("layout_scores").alias("s"), F.col("page_map").alias("m")), lambda z: z["m"] >= 0
    )
    worst = F.array_min(F.transform(scored, lambda z: z["s"]))
    by_widget = count(lambda s: is_true(s["source_widget"]))

    def lost(ft: str) -> Column:
        n = F.lit(0)
        for k in V.CORE_SLOTS[ft]:
            n = n + F.when(slot(k).isNotNull() & ~is_true(slot(k)["located"]), 1).otherwise(0)
        return n

    n_lost = F.when(F.col("form_type") == "F10", lost("F10")).when(F.col("form_type") == "F174", lost("F174")).otherwise(0)
    unread = count(lambda s: is_true((s["source"] == "ink") & (s["ftype"] == "Text")))
    loose = count(lambda s: is_true(s["source_widget"]) & ~is_true(s["within_tolerance"]))
    dated = is_true(slot("date")["filled"]) | is_true(slot("date_awarded")["filled"])
    issuer_open = is_false(F.col("issuer_signed")) & (is_true(F.col("recipient_signed")) | is_true(F.col("aoc_signed")))
    n = lambda c: c.cast("string")
    none = F.lit("")
    mode = F.col("mode")
    return [
        ("scan_replaced", "review", is_true(F.col("scan_replaced")), none),
        ("no_pos_neg", "review", F.coalesce("file_pos_neg", none) == "", none),
        ("no_reason", "warn", F.coalesce("file_reason", none) == "", none),
        ("type_note", "review", F.coalesce("type_note", none) != "", F.col("type_note")),
        ("extra_pages", "review", F.col("page_count") > F.col("template_pages"), n(F.col("page_count"))),
        ("page_missing", "review", unplaced_page & (count(lambda s: s["page"].isNull()) > 0), none),
        ("few_fields", "review", (mode == "fields") & (by_widget < 0.8 * F.greatest(F.size("slots"), F.lit(1))), n(by_widget)),
        ("flattened", "review", mode == "text", none),
        ("scanned", "review", mode == "raster", none),
        ("layout_differs", "review", worst < 0.45, none),
        ("not_located", "review", n_lost > 0, n(n_lost)),
        ("handwriting", "warn", (unread > 0) & (mode != "raster"), n(unread)),
        ("no_date", "warn", ~dated, none),
        ("loose_fields", "warn", loose > 0, n(loose)),
        ("extra_fields", "warn", F.col("extra_widgets") > 0, n(F.col("extra_widgets"))),
        ("issuer_missing", "warn", issuer_open, none),
    ]


def issues(cases: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds `issues`: array of (level, code, detail). An unreadable case has that one issue only."""
    entry = lambda level, code, detail: F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), F.coalesce(detail, F.lit("")).alias("detail")
    )
    found = F.array_compact(F.array(
        *[F.when(is_true(cond), entry(level, code, detail)) for code, level, cond, detail in issue_rules(settings)]
    ))
    broken = F.coalesce("error", F.lit("")) != ""
    return cases.withColumn(
        "issues", F.when(broken, F.array(entry("review", "unreadable", F.col("error")))).otherwise(found)
    )


def review_status(cases: DataFrame) -> DataFrame:
    """flagged, needs_review from the issues and the lifecycle flags."""
    flagged = F.exists("issues", lambda i: i["level"] == "review")
    return cases.withColumn("flagged", flagged).withColumn(
        "needs_review",
        F.col("flagged") & ~is_true(F.col("reviewed")) & ~is_true(F.col("archived")) & ~is_true(F.col("rejected")),
    )


def signed_check(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Warning code for a copy that came back for a step: unreadable, unsigned or none.

    items: item_id, kind, step, form_type, error, slots, field_overrides.
    """
    has_slot, signed = F.lit(False), F.lit(False)
    for ft in V.STEP_SLOTS:
        for step, keys in settings.step_slots(ft).items():
            here = (F.col("form_type") == ft) & (F.col("step") == step)
            for k in keys:
                has_slot = has_slot | here
                signed = signed | (here & _is_filled(k))
    warning = (
        F.when(F.col("kind") != "returned", None)
        .when(F.coalesce("error", F.lit("")) != "", "unreadable")
        .when(is_true(has_slot) & ~is_true(signed), "unsigned")
    )
    return items.withColumn("warning", warning)


def build_roster(cases: DataFrame, order_col: str) -> DataFrame:
    """Name key -> class year from cases where list lengths agree; the last by `order_col` wins.

    cases: recipient_list, raw_years (text), order_col.
    """
    n = F.size("recipient_list")
    years = F.when(n > 1, F.transform(F.split("raw_years", ","), parse_class_year)).otherwise(
        F.array(parse_class_year("raw_years"))
    )
    pairs = F.arrays_zip(F.col("recipient_list").alias("name"), F.col("__years").alias("year"))
    rows = (
        cases.withColumn("__years", years).where((n > 0) & (F.size("__years") == n))
        .select(F.col(order_col).alias("__o"), F.posexplode(pairs).alias("__i", "p"))
        .where(F.col("p.year").rlike(r"^20\d{2}$"))
        .select(name_key("p.name").alias("name_key"), F.col("p.year").alias("class_year"),
                F.struct("__o", "__i").alias("__w"))
    )
    return rows.groupBy("name_key").agg(F.max_by("class_year", "__w").alias("class_year"))
