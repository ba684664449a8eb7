"""Delimited text read by splits.

Whether a line break ends a record depends on all quotes before it, so readers give such a file to one task. Here every line is a map:
the state it ends in (within quotes or not) for each state it may start in. Maps are composed within a split, the splits' maps, one row
each, in file order, and a line's state is that of its split followed by that of the lines before it. Lines that are records of their own
stay where they are; only the lines of records with line breaks meet.

A quote opens at the start of a cell only and is text elsewhere; two within quotes are one. Line breaks within quotes become "\\n". Empty
lines are no records; a quote that is never closed takes in the rest of its file. A byte order mark at the start of a file goes. A
compressed file is one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: States between quotes: within quotes; a quote just closed; at the start of a cell; within a cell.
WITHIN, CLOSED, EMPTY, FULL = range(4)


def _kind(piece: Column, sep: str) -> Column:
    """The state that text outside quotes leads to."""
    return F.when(piece == "", F.lit(CLOSED)).when(piece.endswith(sep), F.lit(EMPTY)).otherwise(F.lit(FULL))


def _step(state: Column, kind: Column) -> Column:
    """The state after a quote and the piece of text behind it."""
    return (F.when(state == WITHIN, kind)
            .when(state.isin(CLOSED, EMPTY), F.lit(WITHIN))
            .otherwise(F.when(kind == EMPTY, F.lit(EMPTY)).otherwise(F.lit(FULL))))


def _first(pieces: Column, sep: str) -> Column:
    return F.when((pieces[0] == "") | pieces[0].endswith(sep), F.lit(EMPTY)).otherwise(F.lit(FULL))


def _ends_within(line: Column, sep: str, within: bool) -> Column:
    """Whether a line that starts within quotes or not ends within them."""
    pieces = F.split(line, '"', -1)
    kinds = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: _kind(p, sep))
    end = F.aggregate(kinds, F.lit(WITHIN) if within else _first(pieces, sep), _step)
    return F.when(line.contains('"'), end == WITHIN).otherwise(F.lit(within))


def _cells(record: Column, sep: str) -> Column:
    """Number of cells of a record: one more than separators outside quotes."""
    pieces = F.split(record, '"', -1)
    seps = lambda p: F.length(p) - F.length(F.replace(p, F.lit(sep), F.lit("")))
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.struct(_kind(p, sep).alias("kind"), seps(p).alias("n")))
    start = F.struct(_first(pieces, sep).alias("state"), (seps(pieces[0]) + 1).alias("n"))

    def add(acc, p):
        state = _step(acc["state"], p["kind"])
        return F.struct(state.alias("state"), (acc["n"] + F.when(state == WITHIN, 0).otherwise(p["n"])).alias("n"))

    return F.when(record.contains('"'), F.aggregate(rest, start, add)["n"]).otherwise(seps(record) + 1)


def _compose(df: DataFrame, window, outside: Column, within: Column) -> DataFrame:
    """Composition of the maps up to each row: `flips` (bit), on the start state or, if `fixed`, on no state."""
    df = df.withColumn("__o", outside.cast("int")).withColumn("__w", within.cast("int"))
    df = df.withColumn("__s", F.sum(F.when((F.col("__o") == 1) & (F.col("__w") == 0), 1).otherwise(0)).over(window))
    df = df.withColumn("__c", F.last(F.when(F.col("__o") == F.col("__w"), F.struct("__o", "__s")), ignorenulls=True).over(window))
    flips = (F.coalesce("__c.__o", F.lit(0)) + F.col("__s") - F.coalesce("__c.__s", F.lit(0))) % 2
    return df.withColumn("fixed", F.col("__c").isNotNull()).withColumn("flips", flips).drop("__o", "__w", "__s", "__c")


def _state(start: Column, fixed: str, flips: str) -> Column:
    """0 outside quotes, 1 within."""
    return F.when(F.col(fixed), F.col(flips)).otherwise((start + F.col(flips)) % 2)


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(row, text): the records of delimited files; row is the number of a record's first line, from 1, files by name."""
    here = W.partitionBy("file", "start").orderBy("id")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("nth", F.row_number().over(here).cast("bigint"))
    lines = lines.withColumn("value", F.when((F.col("start") == 0) & (F.col("nth") == 1), F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    lines = _compose(lines, here, _ends_within(F.col("value"), sep, False), _ends_within(F.col("value"), sep, True))
    lines = lines.withColumn("fixed_b", F.lag("fixed", 1, False).over(here)).withColumn("flips_b", F.lag("flips", 1, 0).over(here))

    # one row a split: its map, its lines, and where its last record starts for either state
    def last_start(x):
        return F.max(F.when(_state(F.lit(x), "fixed_b", "flips_b") == 0, F.col("nth")))

    splits = lines.groupBy("file", "start").agg(
        F.max_by(F.struct("fixed", "flips"), "nth").alias("m"), F.count("*").alias("n"), last_start(0).alias("last_0"), last_start(1).alias("last_1"))
    in_file = W.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    splits = _compose(splits.select("*", "m.*").drop("m"), in_file, F.col("flips") == 1, F.when(F.col("fixed"), F.col("flips")).otherwise(1 - F.col("flips")))
    splits = splits.withColumn("x", F.lag("flips", 1, 0).over(in_file))  # a file starts outside quotes
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    started = F.when(F.col("x") == 0, F.col("last_0")).otherwise(F.col("last_1")) + F.col("before")
    splits = splits.withColumn("carried", F.last(started, ignorenulls=True).over(earlier)).select("file", "start", "x", "before", "carried")

    lines = lines.join(splits, ["file", "start"])
    starts, ends = _state(F.col("x"), "fixed_b", "flips_b") == 0, _state(F.col("x"), "fixed", "flips") == 0
    lines = lines.select("file", "start", "id", "value", "carried", (F.col("before") + F.col("nth")).alias("line"), starts.alias("starts"), ends.alias("ends"))
    first = F.coalesce(F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(here), F.col("carried"))
    lines = lines.withColumn("row", first)
    single = F.col("starts") & F.col("ends")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda p: p["value"])
    several = lines.where(~single).groupBy("row").agg(F.array_join(parts, "\n").alias("text"))
    return lines.where(single).select("row", F.col("value").alias("text")).unionByName(several).where("text <> ''")


def read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(row, cells): every record's cells, as many as the widest record has; missing ones are empty."""
    found = records(spark, path, sep)
    widest = found.agg(F.max(_cells(F.col("text"), sep))).first()[0] or 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(widest)])
    options = {"sep": sep, "quote": '"', "escape": '"', "maxColumns": str(widest + 1), "maxCharsPerColumn": "-1",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\x00"}
    parsed = found.select("row", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("c"))
    return parsed.select("row", F.array(*[F.coalesce(F.col(f"c.c{i}"), F.lit("")) for i in range(widest)]).alias("cells"))
