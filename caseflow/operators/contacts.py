"""Contacts: finding name and address pairs in sheets, and tying them to parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import collapse, display_name, emails_in, let, name_from_address, name_key, name_likeness
from ..functions.text import clean_email, is_email
from ..session import cut_lineage
from .match import best_match, canonicalise, name_pairs, without_ruled
from .scale import is_true, running_last, spread

#: Columns of sheets that are sent to all tasks at most; more are merged.
SENT_COLUMNS = 100_000


def first_addresses(found: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence of every address. found: email and the order columns, plus anything else."""
    rest = [c for c in found.columns if c not in ("email", *order)]
    picked = found.groupBy("email").agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("w"))
    return picked.select("email", *[F.col(f"w.{c}").alias(c) for c in (*order, *rest)])


def addresses(rows: DataFrame) -> DataFrame:
    """Every valid address in rows of cells (sheet, row, cells), first occurrence kept."""
    marked = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("col"), c.alias("cell"))), lambda x: F.contains(x["cell"], F.lit("@")))
    some = rows.where(F.exists("cells", lambda c: F.contains(c, F.lit("@"))))  # cells are taken out of such rows only
    hits = some.select("sheet", "row", "cells", F.explode(marked).alias("hit")).select("sheet", "row", "cells", "hit.*")
    each = hits.select("*", F.posexplode(emails_in("cell")).alias("nth", "raw")).withColumn("email", clean_email(F.col("raw")))
    return first_addresses(each.where(is_email("email")), ["sheet", "row", "col", "nth"])


def rows_with_address(rows: DataFrame) -> DataFrame:
    has = F.exists("cells", lambda c: F.coalesce(c, F.lit("")).rlike(V.EMAIL))
    return rows.agg(F.count_if(has).alias("rows_with_email"))


def _same_cell_name() -> Column:
    """What is left of the cell around the address."""
    at = F.expr("instr(cell, raw)")
    rest = F.concat(
        F.substr(F.col("cell"), F.lit(1), at - 1), F.lit(" "), F.substr(F.col("cell"), at + F.length("raw"))
    )
    bare = F.regexp_replace(F.regexp_replace(rest, r'[<>"();,]', " "), V.EMAIL, " ")
    return collapse(bare)


def _headers(rows: DataFrame, wanted: DataFrame, block: int = 4096) -> DataFrame:
    """Nearest non-blank cell above each wanted (sheet, col, row) in a row without an address.

    Only cells above a wanted one are taken out of their rows: of wanted columns, down to the last wanted row.
    """
    wanted = cut_lineage(wanted.select("sheet", "col", "row").distinct(), "wanted")
    columns = wanted.groupBy("sheet", "col").agg(F.max("row").alias("last"))
    few = columns.limit(SENT_COLUMNS + 1).count() <= SENT_COLUMNS
    sheets = columns.groupBy("sheet").agg(F.collect_list(F.struct("col", "last")).alias("columns"), F.max("last").alias("last"))
    above = rows.join(F.broadcast(sheets) if few else sheets.hint("merge"), "sheet").where(F.col("row") < F.col("last"))
    no_address = ~F.exists("cells", lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("@")) & c.rlike(V.EMAIL))
    asked = F.filter("columns", lambda x: (x["last"] > F.col("row")) & (x["col"] < F.size("cells")))
    cells = above.where(no_address).select("sheet", "row", F.explode(F.transform(asked, lambda x: F.struct(x["col"].alias("col"), F.get("cells", x["col"]).alias("cell")))).alias("x")).select(
        "sheet", "x.col", "row", F.lower(collapse(F.col("x.cell"))).alias("text"), F.lit(0).alias("side")
    ).where("text <> ''")
    ask = wanted.withColumn("text", F.lit(None).cast("string")).withColumn("side", F.lit(1)).select("sheet", "col", "row", "text", "side")
    merged = running_last(
        cells.unionByName(ask), ["sheet", "col"], [F.col("row"), -F.col("side")], F.floor(F.col("row") / block),
        F.col("text"), "header",
    )
    return cut_lineage(merged.where(F.col("side") == 1).select("sheet", "col", "row", F.coalesce("header", F.lit("")).alias("header")), "headers")


def extract(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Name and address pairs (name, email, guessed, sheet, row) from sheets with no assumed layout.

    The name comes from the address's own cell, else from the best of up to four filled cells to its left (one
    cell, or two neighbouring single words), else from the address itself. Resembling a known name counts more
    than merely looking like one. rows: sheet, row, cells ARRAY<STRING>; known: name.
    """
    found = addresses(rows).withColumn("own", _same_cell_name())
    found = found.withColumn("own", F.when((F.col("own") != "") & (name_likeness("own") > 0), F.col("own")).otherwise(""))
    found = cut_lineage(spread(found, "email"), "addresses")
    todo = found.where("own = ''")

    left = F.transform(
        F.filter(
            F.transform(F.sequence(F.col("col") - 1, F.lit(0), F.lit(-1)), lambda k: F.struct(
                k.alias("k"), collapse(F.get("cells", k)).alias("text"))),
            lambda x: x["text"] != "",
        ),
        lambda x: F.struct(x["k"].alias("k"), x["text"].alias("text"), name_likeness(x["text"]).alias("like")),
    )
    left = F.when(F.col("col") > 0, F.slice(left, 1, 4)).otherwise(
        F.array().cast("array<struct<k:int,text:string,like:double>>")
    )
    todo = todo.withColumn("left", left)
    def neighbours(cells: Column) -> Column:
        """Pairs of adjacent single words, nearest first."""
        def pair(x: Column, i: Column) -> Column:
            n = F.get(cells, i + 1)
            joins = is_true(
                n.isNotNull() & (x["k"] - n["k"] == 1) & (x["like"] > 0) & (n["like"] > 0)
                & ~x["text"].rlike(V.WHITESPACE) & ~n["text"].rlike(V.WHITESPACE)
            )
            return F.when(joins, F.struct(i.alias("i"), x["k"].alias("k"), x["text"].alias("near"), n["k"].alias("fk"), n["text"].alias("far")))

        return F.filter(F.transform(cells, pair), lambda z: z.isNotNull())

    singles = todo.select("email", F.posexplode("left").alias("i", "x")).where("x.like > 0").select(
        "email", (F.col("i") * 2).alias("seq"), F.col("x.text").alias("name"), (F.col("x.like") - F.col("i") * 0.6).alias("score")
    )
    paired = let(F.col("left"), neighbours)
    two = todo.select("email", "sheet", "row", F.explode(paired).alias("z")).select("email", "sheet", "row", "z.*")
    wanted = two.select("sheet", F.col("k").alias("col"), "row").unionByName(two.select("sheet", F.col("fk").alias("col"), "row"))
    heads = _headers(rows, wanted)
    near_h = heads.select("sheet", "row", F.col("col").alias("k"), F.col("header").alias("near_h"))
    far_h = heads.select("sheet", "row", F.col("col").alias("fk"), F.col("header").alias("far_h"))
    # cells are taken out of arrays, so files say little about their size: merged, never sent to the driver
    two = two.join(near_h.hint("merge"), ["sheet", "row", "k"], "left").join(far_h.hint("merge"), ["sheet", "row", "fk"], "left")
    swapped = is_true(F.col("far_h").rlike(V.LAST_NAME_HEADER) & F.col("near_h").rlike(V.FIRST_NAME_HEADER))
    doubles = two.select(
        "email", (F.col("i") * 2 + 1).alias("seq"),
        F.when(swapped, F.concat_ws(" ", "near", "far")).otherwise(F.concat_ws(" ", "far", "near")).alias("name"),
        (F.lit(4.5) - F.col("i") * 0.6).alias("score"),
    )
    cands = singles.unionByName(doubles)
    if known is not None:
        near = name_pairs(cands.select("name").distinct(), known.select("name").distinct()).groupBy("name").agg(F.min("dist").alias("d"))
        cands = cands.join(near.hint("merge"), "name", "left").withColumn(
            "score", F.col("score") + F.when(F.col("d") <= 2, 6 - F.col("d")).otherwise(0)
        )
    best = cands.groupBy("email").agg(F.max_by("name", F.struct("score", -F.col("seq"))).alias("beside"))
    named = found.join(best.hint("merge"), "email", "left")
    name = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("beside", F.lit("")))
    guess = name_from_address("email")
    return named.select(
        F.when(name != "", name).otherwise(guess).alias("name"), "email",
        ((name == "") & (guess != "")).alias("guessed"), "sheet", "row",
    )


def place(names: DataFrame, known: DataFrame, distinct_pairs: DataFrame | None = None) -> DataFrame:
    """Where each written name goes: (name, placed, party, match) with match same, close or empty.

    known: name, ord.
    """
    hit = best_match(names.select("name").where("name <> ''"), known, distinct_pairs=distinct_pairs).where("not ambiguous")
    return names.select("name").distinct().join(hit.hint("merge"), "name", "left").select(
        "name",
        F.when(F.col("match").isNotNull(), F.col("match")).when(F.col("name") != "", display_name("name")).otherwise("").alias("placed"),
        F.coalesce("match", F.lit("")).alias("party"),
        F.when(F.col("dist") == 0, "same").when(F.col("dist") > 0, "close").otherwise("").alias("match"),
    )


def import_contacts(
    contacts: DataFrame, pairs: DataFrame, known: DataFrame, distinct_pairs: DataFrame | None = None
) -> DataFrame:
    """Classified import: every pair with `existing` true when its address is already there (left untouched)."""
    have = contacts.select(F.col("email").alias("__e")).distinct()
    placed = place(pairs, known, distinct_pairs)
    return pairs.join(placed.hint("merge"), "name", "left").join(have.hint("merge"), F.col("email") == F.col("__e"), "left").select(
        "email", F.col("placed").alias("name"), "party", "match", "guessed",
        F.when(F.col("name") != F.col("placed"), F.col("name")).otherwise("").alias("sheet_name"),
        F.col("__e").isNotNull().alias("existing"),
    )


def merge_contacts(contacts: DataFrame, classified: DataFrame) -> DataFrame:
    """Insert-only merge by address."""
    new = classified.where("not existing").select(
        "email", "name", "party", "match", "guessed", F.lit(False).alias("auto"), F.lit("upload").alias("source")
    )
    return contacts.select("email", "name", "party", "match", "guessed", "auto", "source").unionByName(new)


def import_report(classified: DataFrame) -> DataFrame:
    new = ~F.col("existing")
    return classified.agg(
        F.count("*").alias("found"), F.count_if(new).alias("added"), F.count_if("existing").alias("existing"),
        F.count_if(new & F.col("match").isin("same", "close")).alias("tied"),
        F.count_if(new & (F.col("match") == "close")).alias("close"), F.count_if(new & (F.col("match") == "")).alias("untied"),
        F.count_if(new & F.col("guessed")).alias("guessed"), F.count_if(new & (F.col("name") == "")).alias("nameless"),
    )


def tie_key(contacts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Contacts with the key of the party they are tied to."""
    src = canonicalise(contacts, "party", aliases, "__p") if aliases is not None else contacts.withColumn("__p", F.col("party"))
    return src.withColumn("tie", F.when(F.coalesce("party", F.lit("")) != "", name_key("__p")).otherwise("")).drop("__p")


def with_party(contacts: DataFrame, parties: DataFrame) -> DataFrame:
    """Contacts with class year and case count of their party. contacts: tie; parties: key, class_year, cases."""
    p = parties.select(F.col("key").alias("__k"), F.col("class_year").alias("__y"), F.col("cases").alias("__n"))
    return contacts.join(p, F.col("tie") == F.col("__k"), "left").select(
        *contacts.columns, F.coalesce("__y", F.lit("")).alias("class_year"), F.coalesce("__n", F.lit(0)).alias("cases"),
        F.col("__k").isNotNull().alias("on_file"),
    )


def suggest_links(
    parties: DataFrame, contacts: DataFrame, declined: DataFrame, distinct_pairs: DataFrame | None = None
) -> DataFrame:
    """(key, party, contact_id, contact, dist) for parties with no contact and likely unlinked contacts.

    parties: key, name; contacts: id, name, email, party, tie; declined: contact_id, key.
    """
    tied = contacts.where("tie <> ''").select(F.col("tie").alias("key")).distinct()
    alone = parties.join(tied, "key", "left_anti")
    free = contacts.where((F.coalesce("party", F.lit("")) == "") & (F.col("name") != ""))
    close = name_pairs(alone.select("name").distinct(), free.select("name").distinct())
    close = without_ruled(close, "name", "candidate", distinct_pairs)
    rows = close.join(alone.select("key", "name"), "name").join(
        free.select(F.col("id").alias("contact_id"), F.col("name").alias("candidate")), "candidate"
    )
    return rows.join(declined.select("contact_id", "key"), ["contact_id", "key"], "left_anti").select(
        "key", F.col("name").alias("party"), "contact_id", F.col("candidate").alias("contact"), "dist"
    )


def answer_links(contacts: DataFrame, declined: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts, declined) after "is this that party?" answers (contact_id, party, yes), one per contact."""
    a = answers.select(F.col("contact_id").alias("id"), F.col("party").alias("__p"), "yes")
    j = contacts.join(a.where("yes"), "id", "left")
    linked = F.col("__p").isNotNull()
    out = j.select(*[
        (F.when(linked, collapse("__p")).otherwise(F.col("party")) if c == "party"
         else F.when(linked, "same").otherwise(F.col("match")) if c == "match" else F.col(c)).alias(c)
        for c in contacts.columns
    ])
    no = answers.where("not yes").select("contact_id", name_key("party").alias("key"))
    return out, declined.select("contact_id", "key").unionByName(no).distinct()


def edit_contacts(contacts: DataFrame, declined: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts, declined) after edits (id, party, auto; null = unchanged). A set party clears its refusals."""
    e = edits.select("id", F.col("party").alias("__p"), F.col("auto").alias("__a"), F.lit(True).alias("__e"))
    j = contacts.join(e, "id", "left")
    new = {
        "party": F.coalesce(collapse_null("__p"), F.col("party")),
        "match": F.when(F.col("__p").isNull(), F.col("match")).when(collapse("__p") != "", "same").otherwise(""),
        "auto": F.coalesce("__a", "auto"),
        "guessed": F.when(F.col("__e"), False).otherwise(F.col("guessed")),
    }
    out = j.select(*[new.get(c, F.col(c)).alias(c) for c in contacts.columns])
    relinked = edits.where(F.col("party").isNotNull()).select(F.col("id").alias("contact_id"))
    return out, declined.join(relinked, "contact_id", "left_anti")


def collapse_null(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), collapse(c))


def remove_contacts(contacts: DataFrame, declined: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return contacts.join(gone, "id", "left_anti"), declined.join(
        gone.withColumnRenamed("id", "contact_id"), "contact_id", "left_anti"
    )


def contact_filter(which: str, query: str = "") -> Column:
    """unlinked, check, in, out or all, and a text found in name, address or party."""
    party = F.coalesce("party", F.lit(""))
    hit = F.contains(F.lower(F.concat_ws(" ", "name", "email", party)), F.lit(query.strip().lower()))
    kind = {
        "unlinked": party == "", "check": is_true(F.col("guessed")) | is_true(F.col("match") == "close") | (party == ""),
        "in": is_true(F.col("auto")), "out": ~is_true(F.col("auto")),
    }.get(which, F.lit(True))
    return hit & kind


def reachability(chosen: DataFrame, parties: DataFrame, contacts: DataFrame) -> DataFrame:
    """(key, name, emails, reason) for chosen keys: how many addresses, and why someone is left out."""
    mail = contacts.where("tie <> ''").groupBy(F.col("tie").alias("key")).agg(F.count("*").alias("emails"))
    j = chosen.select("key").distinct().join(parties.select("key", "name"), "key", "left").join(mail, "key", "left")
    reason = F.when(F.col("name").isNull(), "no active paperwork on file").when(F.col("emails").isNull(), "no email on file")
    return j.select("key", F.coalesce("name", "key").alias("name"), F.coalesce("emails", F.lit(0)).alias("emails"), reason.alias("reason"))
