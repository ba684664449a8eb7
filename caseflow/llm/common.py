"""What several operators share: reading, scratch tables, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_scratch, scratch_path, ship

__all__ = ["read", "cut_lineage", "kept", "drop", "release", "scratch_path", "ship", "map_batches", "held_out", "components"]


def kept(df: DataFrame, label: str) -> DataFrame:
    """Like cut_lineage, but the table can be dropped when nothing reads it any more."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of kept(). All that was derived from them must be written by now."""
    for t in tables:
        if t is not None:
            drop_scratch(t.sparkSession, t.scratch)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted: Spark does so once the driver's collector finds them unreferenced, which on a
    driver with much memory can be long after the disks of the executors are full."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply fn to Arrow batches of df; None adds nothing. Columns may have any name."""
    names = df.columns
    if any("." in n or "`" in n for n in names):  # mapInArrow would take a dot for a field
        df = df.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b.rename_columns(names))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def held_out(doc_id: str, parts: int, part: int):
    """True where crc32 of the id as text falls to `part`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


#: Rows of a table of edges that one task writes; few edges then are few files and tasks.
EDGES_PER_TASK = 100_000


def components(edges: DataFrame, label: str = "components", max_rounds: int = 200) -> DataFrame:
    """(node, root): root is the smallest node that undirected `edges` (a, b of bigint) reach. Nodes without edges are left out.

    Large-star and small-star rounds: every round links each node to the smallest neighbour it knows, with partial minima, so a
    hub of any degree is an aggregate and not a list. Ends when nothing changes; a bound on rounds raises instead of giving
    unfinished labels.
    """
    cur = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    last = None
    for _ in range(max_rounds):
        state = cur.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or tuple(state) == last:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select("v", "v")).distinct()
        last = tuple(state)
        tasks = 1 + state["n"] // EDGES_PER_TASK
        # large star: larger neighbours of each node go to its smallest neighbour, itself included
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, cur = cur, kept(small.where("u <> v").distinct().coalesce(tasks), label)
        drop(before)
    raise RuntimeError(f"{label}: not stable after {max_rounds} rounds")


LONG, STR, BOOL, DBL = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()
