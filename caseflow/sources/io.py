"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import collapse, date_to_serial
from ..operators.reports import next_step, parsed
from ..operators.scale import is_false, is_true
from . import delimited
from .digests import file_digests  # noqa: F401

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("sha1", T.StringType()),
    T.StructField("parser_version", T.IntegerType()), T.StructField("form_type", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("page_count", T.IntegerType()),
    T.StructField("overrides", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reviewed", T.BooleanType()), T.StructField("logged", T.BooleanType()),
    T.StructField("archived", T.BooleanType()), T.StructField("rejected", T.BooleanType()),
    T.StructField("missing", T.BooleanType()), T.StructField("notes", T.StringType()),
])


def list_folder(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]", exclude: list[str] | None = None) -> DataFrame:
    """Files of a folder with size and time; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return out.where(~F.lower("filename").isin([e.lower() for e in exclude])) if exclude else out


def sniff_delimiter(first_line: str, filename: str = "") -> str:
    count = first_line.count
    if filename.lower().endswith(".tsv") or count("\t") > count(","):
        return "\t"
    return ";" if count(";") > count(",") else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Rows of cells (sheet, row, cells) of a delimited file with quoted cells and line breaks inside quotes."""
    first = spark.read.text(path).limit(1).collect()
    line = (first[0][0] if first else "").lstrip("﻿")
    sep = sniff_delimiter(line, path)
    return delimited.read(spark, path, sep).select(F.lit(path).alias("sheet"), "row", "cells")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case catalog from JSON files with a declared schema."""
    return spark.read.schema(CASE_SCHEMA).json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").parquet(path)


def tsv_rows(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Output rows ready for a tab-separated file: chosen cases, cells free of tabs and line breaks.

    rows: case_id, filename, date_iso, pos, and the output columns.
    """
    chosen = rows if ids is None else rows.join(ids.select("case_id").distinct(), "case_id", "left_semi")
    return chosen.select(
        "case_id", "pos", "filename", "date_iso", *[collapse(F.col(f"`{c}`")).alias(c) for c in V.OUTPUT_COLUMNS]
    )


def export_tsv(rows: DataFrame, path: str, ids: DataFrame | None = None, header: bool = False) -> None:
    """Oldest first. The sort is a range sort, so the files in name order hold the whole order."""
    key = F.concat(F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), F.lit("")), F.lower("filename"))
    ordered = tsv_rows(rows, ids).orderBy(key, "pos").select(*[F.col(f"`{c}`") for c in V.OUTPUT_COLUMNS])
    ordered.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def step_folders(records: DataFrame) -> DataFrame:
    """Active, read cases with the folder of their next step."""
    folder = F.create_map(*[F.lit(x) for kv in V.STEP_FOLDERS.items() for x in kv])
    return records.where(parsed()).withColumn("next_step", next_step()).withColumn(
        "folder", F.try_element_at(folder, F.col("next_step"))
    )


def split_by_step(records: DataFrame, path: str) -> None:
    """Rewrite one folder per step. Rows spread over tasks by case, so a crowded step is many files."""
    step_folders(records).repartition("next_step", "case_id").write.mode("overwrite").partitionBy("next_step").parquet(path)


def step_folder_counts(records: DataFrame) -> DataFrame:
    """Cases per step folder, and the ones skipped because they could not be read."""
    usable = ~is_true(F.col("missing")) & ~is_true(F.col("archived")) & ~is_true(F.col("rejected"))
    step = F.when(is_true(F.col("parsed")), next_step()).otherwise("skipped")
    return records.where(usable).groupBy(step.alias("next_step")).agg(F.count("*").alias("n"))


def push_columns(rows: DataFrame, columns: list[tuple[str, str]] = V.PUSH_COLUMNS, respell: DataFrame | None = None) -> DataFrame:
    """The conduct log under configured headings and sources, for active, read cases; cells are text.

    rows: one per (case, party) with a column per source key, date_iso, filename, rejected, complete, squadron; rows of missing,
    archived or unread cases (columns missing, archived, parsed, where there are) are left out. respell: (name, spelling), the way another
    sheet writes a recipient, one row a name. Blank cells are null; a readable date is its serial, another one its text; in number columns
    a plain number is written as short as it can be ("3.50" is 3.5), other text stays text.
    """
    for c in ("missing", "archived"):
        if c in rows.columns:
            rows = rows.where(~is_true(F.col(c)))
    if "parsed" in rows.columns:
        rows = rows.where(is_true(F.col("parsed")))
    if respell is not None:
        names = respell.select(F.col("name").alias("__as"), F.col("spelling").alias("__to"))
        rows = rows.join(names, F.col("recipient") == F.col("__as"), "left").withColumn("recipient", F.coalesce("__to", "recipient"))
    status = F.when(is_true(F.col("rejected")), "Rejected").when(is_true(F.col("complete")), "Complete").otherwise("In progress")

    def cell(source: str) -> Column:
        if source == "status":
            return status
        if source == "date":
            return F.coalesce(date_to_serial("date_iso").cast("string"), F.when(F.col("date") != "", F.col("date")))
        c = collapse(source) if source == "squadron" else F.col(source)
        if source in V.NUMERIC_SOURCES:
            n = c.try_cast("double")
            whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
            c = F.when(c.rlike(r"^-?\d+(\.\d+)?\z"), F.when(whole, n.cast("bigint").cast("string")).otherwise(n.cast("string"))).otherwise(c)
        return F.when(c != "", c)

    return rows.select(
        F.coalesce("date_iso", F.lit("9999-12-31").cast("date")).alias("sort_date"), F.col("filename").alias("sort_name"),
        *[cell(s).alias(h) for h, s in columns],
    )


def write_push(rows: DataFrame, path: str, columns: list[tuple[str, str]] = V.PUSH_COLUMNS) -> None:
    push_columns(rows, columns).orderBy("sort_date", "sort_name").drop("sort_date", "sort_name").write.mode("overwrite").parquet(path)


def awaiting_step(records: DataFrame, step: str) -> DataFrame:
    return records.where(parsed() & is_false(F.col(step)))
