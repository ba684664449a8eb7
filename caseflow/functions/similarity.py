"""String and vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let, text


def bigrams(c: Column | str) -> Column:
    """Every pair of neighbouring characters, repeats kept, in one pass over a text of any length."""
    return F.regexp_extract_all(text(c), F.lit("(?s)(?=(..))"), F.lit(1))


def numbered_bigrams(c: Column | str) -> Column:
    """Bigrams with their occurrence number, which turns a multiset into a set (short strings)."""
    return let(F.array_sort(bigrams(c)), lambda g: F.transform(
        g, lambda x, i: F.concat(x, (i + 2 - F.array_position(g, x)).cast("string"))
    ))


def set_dice(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """Dice of texts a and b whose numbered bigrams sa and sb are at hand."""
    return (
        F.when(a == b, F.when(a != "", 1.0).otherwise(0.0))
        .when((F.size(sa) == 0) | (F.size(sb) == 0), 0.0)
        .otherwise(2.0 * F.size(F.array_intersect(sa, sb)) / (F.size(sa) + F.size(sb)))
    )


def dice(a: Column | str, b: Column | str) -> Column:
    """Sorensen-Dice on character bigrams of two short strings; equal non-empty strings score 1."""
    return let(F.struct(text(a).alias("a"), text(b).alias("b")),
               lambda s: set_dice(s["a"], s["b"], numbered_bigrams(s["a"]), numbered_bigrams(s["b"])))


def unit_vector(v: Column | str) -> Column:
    """Zero-mean, unit-norm copy of a numeric array."""
    def centred(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / F.size(x)
        return let(mean, lambda m: F.transform(x, lambda e: e - m))

    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
        return let(norm, lambda n: F.when(n > 1e-6, F.transform(x, lambda e: e / n)).otherwise(x))

    return let(let(F.transform(col(v), lambda e: e.cast("double")), centred), scaled)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of two vectors that are already unit length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)
