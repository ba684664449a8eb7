"""Person names: ranks, order, keys and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .base import col, let, text
from .text import collapse


#: Every rank word holds one of these; names without them are left as they are.
_RANK_HINT = r"(?i)c[1-4]c|cadet|c/"


def strip_rank(name: Column | str) -> Column:
    """Drop rank words; a "C/..." grade may run into a second word."""
    def kept(tokens: Column) -> Column:
        def by_word(bare: Column) -> Column:
            def keep(t: Column, i: Column) -> Column:
                word = F.get(bare, i)
                second = F.coalesce(F.get(bare, i - 1).startswith("c/"), F.lit(False)) & word.rlike(V.RANK_SECOND_WORD)
                return ~(second | word.rlike(V.RANK_TOKEN) | word.startswith("c/"))

            return F.filter(tokens, keep)

        return let(F.transform(tokens, lambda t: F.lower(F.btrim(t, F.lit(",.")))), by_word)

    def stripped(whole: Column) -> Column:
        joined = F.array_join(let(F.split(whole, " "), kept), " ")
        return F.regexp_replace(F.when(whole.rlike(_RANK_HINT), joined).otherwise(whole), r"^[\s,]+|[\s,]+$", "")

    return let(collapse(name), stripped)


def form_name_to_display(name: Column | str) -> Column:
    """"Last, First MI" -> "First MI Last"."""
    def turned(n: Column) -> Column:
        def ordered(p: Column) -> Column:
            rest = F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), " ")
            return F.when(F.size(p) >= 2, collapse(F.concat_ws(" ", rest, F.get(p, F.lit(0))))).otherwise(n)

        return let(F.filter(F.transform(F.split(n, ","), lambda p: F.trim(p)), lambda p: p != ""), ordered)

    return let(collapse(name), turned)


def single_name(name: Column | str) -> Column:
    """A detected name is always one person: never a list."""
    return strip_rank(F.regexp_replace(form_name_to_display(strip_rank(name)), ",", " "))


def split_names(c: Column | str) -> Column:
    """A typed list of people. A one-word piece is the surname of the piece after it."""
    chunks = F.filter(F.transform(F.split(text(c), r"[,;\n]"), strip_rank), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        lone = acc["carry"].isNull() & (F.instr(x, " ") == 0)
        full = F.when(acc["carry"].isNull(), x).otherwise(collapse(F.concat(x, F.lit(" "), acc["carry"])))
        return F.struct(
            F.when(lone, acc["out"]).otherwise(F.array_append(acc["out"], full)).alias("out"),
            F.when(lone, x).otherwise(F.lit(None).cast("string")).alias("carry"),
        )

    done = lambda acc: F.when(acc["carry"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["carry"]))
    return F.aggregate(chunks, start, step, done)


def name_key(name: Column | str) -> Column:
    """Order-insensitive key of a name: its words of two or more letters, sorted."""
    words = F.filter(F.split(F.lower(strip_rank(name)), "[^a-z]+"), lambda t: F.length(t) > 1)
    return F.array_join(F.array_sort(words), " ")


def title_case(c: Column) -> Column:
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    hyphened = lambda w: F.array_join(F.transform(F.split(w, "-"), word), "-")
    return F.array_join(F.transform(F.split(c, " "), hyphened), " ")


def name_parts(raw: Column | str) -> Column:
    """Struct of tokens, core, comma, given, family, whatever order the name was written in."""
    bare = F.regexp_replace(text(raw), r"<[^>]*>|\([^)]*\)|\"[^\"]*\"", " ")
    letters = F.regexp_replace(
        F.regexp_replace(strip_rank(bare), r"[’']", ""), r"[^A-Za-z,\-\s]", " "
    )

    def clean(s: Column) -> Column:
        toks = F.transform(F.split(F.lower(collapse(s)), " "), lambda t: F.btrim(t, F.lit("-")))
        return F.filter(toks, lambda t: (t != "") & ~t.rlike(f"{V.NAME_SUFFIX}|{V.NAME_HONORIFIC}"))

    def ordered(s: Column) -> Column:
        chunks = F.filter(F.transform(F.split(s, ","), clean), lambda c: F.size(c) > 0)

        def read(ch: Column) -> Column:
            comma = (F.instr(s, ",") > 0) & (F.size(ch) >= 2)
            tokens = F.when(comma, F.concat(F.get(ch, F.lit(1)), F.get(ch, F.lit(0)))).otherwise(F.flatten(ch))
            return let(tokens, lambda t: let(F.filter(t, lambda x: F.length(x) > 1), lambda core: F.struct(
                t.alias("tokens"), core.alias("core"), comma.alias("comma"),
                F.when(F.size(core) > 1, F.slice(core, F.lit(1), F.size(core) - 1)).otherwise(core).alias("given"),
                F.when(F.size(core) > 1, F.element_at(core, -1)).otherwise("").alias("family"),
            )))

        return let(chunks, read)

    return let(letters, ordered)


def _written(raw: Column, word: Column) -> Column:
    """A word of a name as it was written, found by its letters; shouting capitals are softened."""
    hit = F.get(
        F.filter(
            F.split(text(raw), r"(?:,|" + V.WHITESPACE + ")+"),
            lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z-]", "")) == word,
        ),
        F.lit(0),
    )

    def shown(w: Column) -> Column:
        t = F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", "")
        shouting = (F.length(t) > 1) & (t == F.upper(t))
        return F.when(w.isNull(), title_case(word)).when(shouting, title_case(F.lower(t))).otherwise(t)

    return let(hit, shown)


def _parts(raw: Column, parts: Column | None, body) -> Column:
    """`body` of the parts of a name: a column that has them already, else read here, once a row."""
    return let(name_parts(raw), body) if parts is None else body(parts)


def first_name(raw: Column | str, parts: Column | None = None) -> Column:
    raw = col(raw)
    return _parts(raw, parts, lambda p: F.when(
        F.size(p["given"]) > 0, _written(raw, F.get(p["given"], F.lit(0)))
    ).otherwise(F.get(F.split(collapse(raw), " "), F.lit(0))))


def last_name(raw: Column | str, parts: Column | None = None) -> Column:
    raw = col(raw)
    return _parts(
        raw, parts,
        lambda p: let(
            F.when(p["family"] != "", p["family"]).otherwise(F.get(p["core"], F.lit(0))),
            lambda f: F.when(f.isNull(), F.lit("")).otherwise(_written(raw, f)),
        ),
    )


def display_name(raw: Column | str, parts: Column | None = None) -> Column:
    return _parts(col(raw), parts, lambda p: F.when(
        F.size(p["tokens"]) > 0, title_case(F.array_join(p["tokens"], " "))
    ).otherwise(collapse(raw)))


def token_distance(a: Column, b: Column) -> Column:
    """Edits between two words, at most a third of the shorter one's letters; 3 means different."""
    d = F.levenshtein(a, b, 2)
    slack = F.floor(F.least(F.length(a), F.length(b)) / 3)
    return F.when(a == b, 0).when((d >= 0) & (d <= slack), d).otherwise(3)


def readings(p: Column) -> Column:
    """The ways to read a name: as written and, when no comma says so, family name first."""
    written = F.struct(p["given"].alias("given"), p["family"].alias("family"))
    swapped = F.struct(
        F.slice(p["core"], F.lit(2), F.greatest(F.size(p["core"]) - 1, F.lit(0))).alias("given"),
        F.get(p["core"], F.lit(0)).alias("family"),
    )
    return F.when(~p["comma"] & (F.size(p["core"]) > 1), F.array(written, swapped)).otherwise(F.array(written))


def parts_distance(pa: Column, pb: Column) -> Column:
    """Distance 0..3 between two `name_parts` structs."""
    def pair(x: Column, y: Column) -> Column:
        given = F.array_min(F.flatten(F.transform(
            x["given"], lambda g1: F.transform(y["given"], lambda g2: token_distance(g1, g2))
        )))
        total = token_distance(x["family"], y["family"]) + F.coalesce(given, F.lit(3))
        return F.when(total <= 2, total).otherwise(3)

    full = let(readings(pa), lambda ra: let(readings(pb), lambda rb: F.array_min(
        F.flatten(F.transform(ra, lambda x: F.transform(rb, lambda y: pair(x, y))))
    )))
    lone = F.when((F.size(pa["core"]) > 0) & (pa["core"] == pb["core"]), 0).otherwise(3)
    return (
        F.when((F.size(pa["tokens"]) == 0) | (F.size(pb["tokens"]) == 0), 3)
        .when((F.size(pa["core"]) < 2) | (F.size(pb["core"]) < 2), lone)
        .otherwise(full)
    )


def name_distance(a: Column | str, b: Column | str) -> Column:
    return let(name_parts(a), lambda pa: let(name_parts(b), lambda pb: parts_distance(pa, pb)))
