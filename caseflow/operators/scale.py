"""Building blocks that keep a hot key from becoming one task.

A window over one key runs in one task. The running functions here split every key into ordered buckets
(a date, a block of row numbers), reduce the buckets with a partial aggregate, and only window over the
short list of bucket results; rows themselves are windowed per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..session import cut_lineage, scratch_path

_BUCKET = "__bucket"
_OFFSET = "__offset"
_PART = "__part"


def _with_offsets(df: DataFrame, keys: list[str], offsets: DataFrame) -> DataFrame:
    names = [*keys, _BUCKET]
    right = offsets.select(*[F.col(k).alias(f"__r_{k}") for k in names], _OFFSET)
    cond = None
    for k in names:
        c = df[k].eqNullSafe(right[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"__r_{k}" for k in names])


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum of `value` per `keys` in `order`. `bucket` must not decrease along the order."""
    src = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    upto = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    totals = src.groupBy(*keys, _BUCKET).agg(F.sum("__v").alias("__t"))
    offsets = totals.withColumn(_OFFSET, F.coalesce(F.sum("__t").over(upto), F.lit(0)))
    inside = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else W.currentRow
    )
    rows = src.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    joined = _with_offsets(rows, keys, offsets)
    return joined.withColumn(out, F.col("__in") + F.col(_OFFSET)).drop("__v", "__in", _BUCKET, _OFFSET)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """row_number() per `keys` without putting one key into one task."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), out)


def in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows in ranges of `order`, with the number of their range; ranges hold about equally many rows, whatever the values are, as long
    as `order` tells rows apart."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id())


def ordered_total(df: DataFrame, order: list[Column], value: Column, out: str, exclusive: bool = False) -> DataFrame:
    """Running sum of `value` over all rows in `order`, without a key: sums of ranges first, then within each range."""
    ranges = cut_lineage(in_ranges(df.withColumn("__v", value), order), "ranges")  # a range keeps its rows whatever is computed again
    upto = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = ranges.groupBy(_PART).agg(F.sum("__v").alias("__t")).withColumn(_OFFSET, F.coalesce(F.sum("__t").over(upto), F.lit(0)))
    inside = W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    rows = ranges.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return rows.join(offsets.select(_PART, _OFFSET), _PART).withColumn(out, F.col("__in") + F.col(_OFFSET)).drop("__v", "__in", _PART, _OFFSET)


class PageIndex:
    """An order kept as ranges in files, with the number of rows of each: a page reads the one or two ranges it lies in."""

    def __init__(self, df: DataFrame, order: list[Column], parts: int | None = None):
        self.order = order
        path = scratch_path(df.sparkSession, "pages")
        in_ranges(df, order, parts).write.partitionBy(_PART).parquet(path)
        schema = T.StructType([*df.schema.fields, T.StructField(_PART, T.IntegerType())])
        self.table = df.sparkSession.read.schema(schema).parquet(path)
        self.counts = sorted((r[_PART], r["count"]) for r in self.table.groupBy(_PART).count().collect())  # one row a range

    def page(self, number: int, size: int) -> DataFrame:
        """Rows number * size up to (number + 1) * size of the order, in order."""
        first, before, hit = number * size, 0, []
        skip = 0
        for part, n in self.counts:
            if before < first + size and before + n > first:
                if not hit:
                    skip = first - before
                hit.append(part)
            before += n
        # the ranges' folders are all that is read
        return self.table.where(F.col(_PART).isin(hit) if hit else F.lit(False)).drop(_PART).orderBy(*self.order).offset(max(skip, 0)).limit(size)


def running_last(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str
) -> DataFrame:
    """The last non-null `value` strictly before each row, per `keys` in `order`."""
    src = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("__v").alias("v"))
    upto = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    lasts = src.groupBy(*keys, _BUCKET).agg(F.max(F.when(F.col("__v").isNotNull(), ranked))["v"].alias("__l"))
    offsets = lasts.withColumn(_OFFSET, F.last("__l", ignorenulls=True).over(upto))
    inside = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = src.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    joined = _with_offsets(rows, keys, offsets)
    return joined.withColumn(out, F.coalesce("__in", _OFFSET)).drop("__v", "__in", "__l", _BUCKET, _OFFSET)


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key. Spark limits each map task to n rows per key before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_false(c: Column) -> Column:
    """True only for a known false; null means "not applicable" and stays out."""
    return F.coalesce(~c, F.lit(False))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Full parallelism before work that is heavy per row: few bytes can be many seconds, and adaptive
    execution sizes tasks by bytes. A stated number of partitions is left alone."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])
