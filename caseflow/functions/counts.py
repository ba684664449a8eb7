"""Counts written by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .base import let, text
from .text import collapse


def num(c: Column | str) -> Column:
    """Number at the start of a text ("3 tours" -> 3), else 0."""
    return F.coalesce(F.regexp_extract(text(c), V.NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def strip_label(raw: Column | str) -> Column:
    """Drop printed label words at both ends ("4. TOURS 2" -> "2")."""
    def bounds(toks: Column) -> Column:
        is_value = F.transform(toks, lambda t: ~t.rlike(V.LABEL_WORD))

        def cut(flags: Column) -> Column:
            first = F.array_position(flags, True).cast("int")
            last = F.size(flags) + 1 - F.array_position(F.reverse(flags), True).cast("int")
            return F.when(first == 0, "").otherwise(
                F.array_join(F.slice(toks, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), " ")
            )

        return let(is_value, cut)

    return let(F.filter(F.split(collapse(raw), " "), lambda t: t != ""), bounds)


def sanction_count(raw: Column | str, source: Column | None = None, scanned: Column | None = None, bare: Column | None = None) -> Column:
    """A count as text. Blank and N/A are "0", but a blank that could not be read stays "". bare: `strip_label` of it, where a column has it."""
    from_ink = F.lit(False) if source is None else F.coalesce(source == "ink", F.lit(False))
    on_scan = F.lit(False) if scanned is None else F.coalesce(scanned, F.lit(False))

    def read(s: Column) -> Column:
        found = F.regexp_extract(s, V.COUNT_NUMBER, 1)
        blank = F.when((collapse(raw) == "") & (on_scan | from_ink), "").otherwise("0")
        return (
            F.when((s == "") | s.rlike(V.NOTHING), blank)
            .when(found != "", F.regexp_replace(found, r"\.0$", ""))
            .otherwise(s)
        )

    return let(strip_label(raw), read) if bare is None else read(bare)


def other_text(raw: Column | str, bare: Column | None = None) -> Column:
    said = lambda s: F.when((s == "") | s.rlike(V.NOTHING), "").otherwise(s)
    return let(strip_label(raw), said) if bare is None else said(bare)
