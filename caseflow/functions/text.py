"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .base import col, let, text


def collapse(c: Column | str) -> Column:
    """Whitespace runs (Unicode included) become one space; ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text(c), V.WHITESPACE + "+", " "))


def split_camel(c: Column | str) -> Column:
    spaced = F.regexp_replace(text(c), r"(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(spaced, r"(?:-|" + V.WHITESPACE + ")+", " "))


def norm_text(c: Column | str) -> Column:
    """Lower case with every run of other characters than a-z0-9 as one space (headers, match keys)."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def filename_key(c: Column | str) -> Column:
    """What identifies the paperwork in a file name: no extension, copy counter or status words."""
    bare = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\.pdf$", ""), r"\(\d+\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(norm_text(bare), V.COPY_WORDS, " "), r"\s+", " "))


def form_id(filename: Column | str) -> Column:
    return F.substring(F.sha1(F.lower(col(filename))), 1, 14)


def parse_filename(filename: Column | str) -> Column:
    """Struct of recipient, pos_neg, form_type, reason, valid, problems from an underscore-separated name."""
    stem = F.regexp_replace(text(filename), r"(?i)\.pdf$", "")
    parts = F.transform(F.split(stem, "_"), lambda p: F.trim(p))

    def solve(p: Column) -> Column:
        pn = F.array_position(F.transform(p, lambda x: x.rlike(V.POSITIVE_PART) | x.rlike(V.NEGATIVE_PART)), True)
        squeezed = F.transform(p, lambda x: F.regexp_replace(x, " ", ""))
        ft = F.array_position(F.transform(squeezed, lambda x: x.rlike(V.FORM_TYPE_PART)), True)
        return let(F.struct(p.alias("p"), pn.alias("pn"), ft.alias("ft")), described)

    def described(s: Column) -> Column:
        p, pn, ft = s["p"], s["pn"].cast("int"), s["ft"].cast("int")
        has_pn, has_ft = pn > 0, ft > 0
        first = F.when(has_pn & has_ft, F.least(pn, ft)).otherwise(F.greatest(pn, ft))
        last = F.greatest(pn, ft)
        filled = lambda arr: F.array_join(F.filter(arr, lambda x: x != ""), " ")
        recipient = F.when(has_pn | has_ft, filled(F.slice(p, F.lit(1), F.greatest(first - 1, F.lit(0))))).otherwise("")
        reason = F.when(
            has_pn | has_ft, split_camel(filled(F.slice(p, last + 1, F.greatest(F.size(p) - last, F.lit(0)))))
        ).otherwise("")
        pos_neg = F.when(has_pn, F.when(F.get(p, pn - 1).rlike(V.POSITIVE_PART), "Pos").otherwise("Neg")).otherwise("")
        form_type = F.when(
            has_ft,
            F.concat(F.lit("F"), F.regexp_extract(F.regexp_replace(F.get(p, ft - 1), " ", ""), V.FORM_TYPE_PART, 1)),
        ).otherwise("")
        return let(
            F.struct(
                recipient.alias("recipient"), pos_neg.alias("pos_neg"), form_type.alias("form_type"),
                reason.alias("reason"), F.size(p).alias("n"), pn.alias("pn"), ft.alias("ft"),
            ),
            judged,
        )

    def judged(s: Column) -> Column:
        has_marker = (s["pn"] > 0) | (s["ft"] > 0)
        valid = (s["pn"] == 2) & (s["ft"] == 3) & (s["n"] >= 4) & (s["recipient"] != "")
        found = F.array_compact(F.array(
            F.when(s["pn"] == 0, "no Pos/Neg part"),
            F.when(s["ft"] == 0, "no form type part (F10 / F174)"),
            F.when(has_marker & (s["reason"] == ""), "no reason part"),
            F.when(s["recipient"] == "", "no recipient part"),
        ))
        problems = F.when(~valid & (F.size(found) == 0), F.array(F.lit("parts out of order"))).otherwise(found)
        return F.struct(
            s["recipient"].alias("recipient"), s["pos_neg"].alias("pos_neg"), s["form_type"].alias("form_type"),
            s["reason"].alias("reason"), valid.alias("valid"), problems.alias("problems"),
        )

    return let(parts, solve)


def emails_in(c: Column | str) -> Column:
    """Every address found in a text, as written."""
    return F.regexp_extract_all(text(c), F.lit(V.EMAIL), F.lit(0))


def clean_email(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"^['.]+|[.']+$", ""))


def is_email(c: Column | str) -> Column:
    return F.trim(text(c)).rlike(V.EMAIL_WHOLE) & (F.length(text(c)) <= V.EMAIL_MAX)


def name_from_address(email: Column | str) -> Column:
    """"john.doe@x.edu" -> "John Doe", only when the address spells out two or three words."""
    local = F.regexp_replace(F.get(F.split(text(email), "@"), F.lit(0)), r"\d+$", "")
    bits = F.filter(F.split(local, r"[._-]+"), lambda b: b.rlike(r"^[A-Za-z]{2,}$"))
    named = lambda bs: F.when(F.size(bs).between(2, 3), F.array_join(F.transform(bs, lambda b: F.initcap(b)), " "))
    return F.coalesce(let(bits, named), F.lit(""))


def name_likeness(cell: Column | str) -> Column:
    """How much a cell looks like a person's name; 0 means not at all."""
    from .names import name_parts

    def score(s: Column) -> Column:
        def graded(n: Column) -> Column:
            header = (n <= 2) & (F.length(s) < 14) & s.rlike(V.HEADER_WORDS)
            value = (
                F.when(n >= 2, 3.0).otherwise(1.0)
                + F.when(s.rlike(r"^[A-Za-z][A-Za-z'’.\-\s,]*$"), 1.0).otherwise(0.0)
                + F.when(s.rlike("^[A-Z]"), 0.5).otherwise(0.0)
            )
            return F.when((n == 0) | (n > 5) | header, 0.0).otherwise(value)

        empty = (s == "") | (F.length(s) > 60) | (F.contains(s, F.lit("@")) & s.rlike(V.EMAIL)) | s.rlike(r"^[\d\s.,()+\-/:]+$")
        return F.when(empty, 0.0).otherwise(let(F.size(name_parts(s)["core"]), graded))

    return let(collapse(cell), score)


def fill_template(template: Column | str, name: Column, first: Column, last: Column) -> Column:
    """Replace {name}, {first_name}/{firstname} and {last_name}/{lastname}, any case."""
    out = text(template)
    for pattern, value in ((r"(?i)\{name\}", name), (r"(?i)\{first_?name\}", first), (r"(?i)\{last_?name\}", last)):
        literal = F.regexp_replace(value, r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(pattern), literal)
    return out
