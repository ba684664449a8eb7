"""Dates as people write them, class years, month labels and sheet serials."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .base import col, let, text
from .text import collapse


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _valid_date(p: Column) -> Column:
    """Date of a struct (y, m, d) within 2000..2100, else null; a two-digit year is this century's."""
    year = F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])
    ok = year.between(2000, 2100) & p["m"].between(1, 12) & p["d"].between(1, 31)
    return F.when(ok, F.concat_ws("-", year, p["m"], p["d"]).try_cast("date"))


def _month_number(word: Column) -> Column:
    """1 to 12 by the first three letters of a word, else null."""
    at = F.instr(F.lit(" ".join(V.MONTH_NUMBERS)), F.lower(F.substring(word, 1, 3)))
    return F.when((word != "") & (at % 4 == 1), F.floor(at / 4).cast("int") + 1)


def parse_date(raw: Column | str) -> Column:
    """A DATE, or null. The first shape that matches decides; it is not retried as another shape.

    Each shape is sought once; its numbers are then taken out of the few characters that matched.
    """
    ymd = lambda y, m, d: F.struct(_int(y).alias("y"), _int(m).alias("m"), _int(d).alias("d"))

    def shape(s: Column, pattern: str, parts, rest: Column) -> Column:
        return let(F.regexp_extract(s, pattern, 0), lambda t: F.when(t != "", parts(t)).otherwise(rest))

    def numbers(y: int, m: int, d: int):
        return lambda t: let(F.split(F.translate(t, "/.", "--"), "-"), lambda n: ymd(*(F.get(n, F.lit(i)) for i in (y, m, d))))

    def worded(s: Column, pattern: str, word, day, year, rest: Column) -> Column:
        """A day, a month's name and a year; a word that names no month is no match."""
        return let(F.regexp_extract(s, pattern, 0), lambda t: let(_month_number(word(t)), lambda m: F.when(
            m.isNotNull(), ymd(year(t), m, day(t))).otherwise(rest)))

    def read(s: Column) -> Column:
        none = F.lit(None).cast("struct<y:int,m:int,d:int>")
        digits = lambda t: F.translate(t, ascii_letters + " .,-", "")
        month_first = worded(s, V.DATE_MON_D_Y, lambda t: t, lambda t: F.regexp_extract(t, r"\d+", 0), lambda t: F.substring_index(t, " ", -1), none)
        day_first = worded(
            s, V.DATE_D_MON_Y, lambda t: F.ltrim(t, F.lit("0123456789 -")), lambda t: digits(F.substring(t, 1, 2)),
            lambda t: digits(F.substring(t, -4, 4)), month_first)  # three letters at least stand between day and year
        numeric = shape(s, V.DATE_YMD, numbers(0, 1, 2), shape(s, V.DATE_MDY, numbers(2, 0, 1), day_first))
        parted = F.contains(s, F.lit("-")) | F.contains(s, F.lit("/")) | F.contains(s, F.lit("."))
        compact = F.length(s).between(8, 9) & s.rlike(V.DATE_COMPACT)  # `$` may stand before a last line end
        return F.when(compact, ymd(*(F.substring(s, *at) for at in ((1, 4), (5, 2), (7, 2))))).when(parted, numeric).otherwise(day_first)

    return let(let(F.replace(collapse(raw), F.lit("_"), F.lit(" ")), read), _valid_date)


def parse_class_year(raw: Column | str) -> Column:
    def read(s: Column) -> Column:
        marked = F.regexp_extract(s, V.YEAR_MARKED, 1)
        bare = F.regexp_extract(s, V.YEAR_BARE, 1)
        return (
            F.when(s.rlike(V.YEAR_4), F.regexp_extract(s, V.YEAR_4, 1))
            .when(marked != "", F.concat(F.lit("20"), marked))
            .when(bare != "", F.concat(F.lit("20"), bare))
            .otherwise(s)
        )

    return let(collapse(raw), read)


def norm_year(c: Column | str) -> Column:
    t = F.regexp_replace(F.trim(text(c)), r"(?i)^['’]|^c", "")
    return F.when(t.rlike(r"^\d{2}$"), F.concat(F.lit("20"), t)).when(t.rlike(r"^20\d{2}$"), t)


def month_label(d: Column | str, fmt: str = "name") -> Column:
    pattern = {"short": "MMM", "iso": "yyyy-MM", "name_year": "MMMM yyyy", "number": "M"}.get(fmt, "MMMM")
    return F.coalesce(F.date_format(col(d), pattern), F.lit(""))


def display_date(d: Column | str, raw: Column | None = None) -> Column:
    """"7 Sep 26", the raw text when there is no date, or "No date"."""
    fallback = F.lit("No date") if raw is None else F.when(text(raw) != "", raw).otherwise("No date")
    return F.coalesce(F.date_format(col(d), "d MMM yy"), fallback)


def date_to_serial(d: Column | str) -> Column:
    """Spreadsheet day number; day 0 is 1899-12-30."""
    n = F.datediff(col(d), F.lit("1899-12-30").cast("date"))
    return F.when(n > 0, n)


def serial_to_date(n: Column | str) -> Column:
    v = col(n).try_cast("double")
    return F.when(v.between(1, 100000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(v).cast("int")))


def days_ago(today: Column | str, n: int) -> Column:
    return F.date_sub(col(today), n)
