"""Exact duplicates by snapshots and static filters.

The rows fall into an immutable snapshot and an incoming batch. The snapshot keeps its distinct digests and, per bucket of
digests, one binary fuse filter. Each distinct incoming digest is screened by its bucket's filter. Positives join the
snapshot's digests exactly, false positives fall out there; negatives are new for certain and are grouped among themselves
only. Groups of two or more rows are then compared byte by byte with one of their rows; should two texts share a digest, they
become groups of their own.

Defined results: a null text is an empty text; all empty or white texts are one group; among rows with equal code points and
equal doc_id one stays; a null doc_id comes after all others; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .common import cut_lineage

#: Keys of one filter; bounds the memory of the task that builds it.
FILTER_KEYS = 200_000
#: Digests that are sent to all executors at most; more go through a shuffle join.
BROADCAST_DIGESTS = 500_000
_WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def by_id(share: int = 2) -> Column:
    """The default snapshot: half of the rows by a hash of their id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0


def build_snapshot(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, seg, segments, cells): one filter per bucket of the distinct `key`s."""
    def make(key, table):
        f = fuse_filter.build(table["key"].to_numpy().view(np.uint64))
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([f["seed"]], pa.int64()), "seg": pa.array([f["seg"]], pa.int64()),
            "segments": pa.array([f["segments"]], pa.int64()), "cells": pa.array([f["cells"].tobytes()], pa.binary()),
        })

    keyed = digests.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key")
    return keyed.groupBy("bucket").applyInArrow(make, "bucket long, seed long, seg long, segments long, cells binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest, key, maybe): maybe is false only for a digest the snapshot certainly lacks. One row per distinct digest goes in."""
    def test(key, left, right):
        keys = left["key"].to_numpy().view(np.uint64)
        maybe = np.zeros(len(keys), bool)
        for r in right.to_pylist():
            f = {"seed": r["seed"], "seg": r["seg"], "segments": r["segments"], "cells": np.frombuffer(r["cells"], np.uint16)}
            maybe |= fuse_filter.contains(f, keys)
        return pa.table({"digest": left["digest"], "key": left["key"], "maybe": pa.array(maybe)})

    left = digests.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key", "digest")
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "digest string, key long, maybe boolean")


def dedup(docs: DataFrame, snapshot: Column | None = None, digest_of: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, uid) for every row of docs (doc_id, text). uid numbers the rows of one call."""
    snapshot = by_id() if snapshot is None else snapshot
    norm = normalised(F.col("text"))
    base = cut_lineage(
        docs.select("doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), digest_of(norm).alias("digest"), sha256(norm).alias("sha"), F.coalesce(snapshot, F.lit(True)).alias("old"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "dedup-digests",
    )
    groups = _groups(base)
    variants = _variants(docs, base, groups, norm, digest_of)
    if variants is not None:
        base = cut_lineage(
            base.join(variants, (F.col("digest") == F.col("v_digest")) & F.col("doc_id").eqNullSafe(F.col("v_doc")) & (F.col("sha") == F.col("v_sha")), "left")
            .withColumn("digest", F.concat_ws(":", "digest", F.col("variant").cast("string"))).select(*base.columns), "dedup-variants",
        )
        groups = _groups(base)
    return base.join(groups, "digest").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "uid",
    )


def _summary(rows: DataFrame) -> DataFrame:
    """Longest text, then smallest id (null last), then row number: a minimum, so a hot group is combined before the shuffle."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best")
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), best).withColumn("key", F.xxhash64("digest"))


def _groups(base: DataFrame) -> DataFrame:
    both = cut_lineage(_summary(base.where("old")).withColumn("old", F.lit(True)).union(_summary(base.where("not old")).withColumn("old", F.lit(False))), "dedup-groups")
    old, new = both.where("old").drop("old"), both.where("not old").drop("old")
    size = both.groupBy("old").count().toPandas()
    buckets = max(1, -(-int(size["count"].max() if len(size) else 0) // FILTER_KEYS))
    screened = screen(new, build_snapshot(old, buckets), buckets)
    exact = screened.where("maybe").select("digest").join(old.select("digest"), "digest", "left_semi")  # false positives fall out
    met = cut_lineage(exact, "dedup-met")
    fresh = new.join(met, "digest", "left_anti")
    merged = old.join(new.join(met, "digest", "left_semi").select("digest", F.col("group_size").alias("more"), F.col("best").alias("other")), "digest", "left").select(
        "digest", (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"), F.least("best", F.coalesce("other", "best")).alias("best"),
    )
    return cut_lineage(merged.union(fresh.select("digest", "group_size", "best")), "dedup-merged")


def _variants(docs: DataFrame, base: DataFrame, groups: DataFrame, norm: Column, digest_of) -> DataFrame | None:
    """Byte check of all groups of two or more. None if every group holds one text; else which row has which text."""
    multi = groups.where("group_size > 1").select("digest")
    n = multi.count()
    if not n:
        return None
    multi = F.broadcast(multi) if n <= BROADCAST_DIGESTS else multi
    rows = docs.select("doc_id", "text").select("doc_id", norm.alias("norm")).withColumn("digest", digest_of(F.col("norm"))).join(multi, "digest", "left_semi")
    one = rows.groupBy("digest").agg(F.min(F.struct(F.octet_length("norm").alias("size"), F.col("norm")))["norm"].alias("one"))
    bad = rows.join(one, "digest").where(F.col("norm") != F.col("one")).select("digest").distinct()
    bad = cut_lineage(bad, "dedup-bytes")
    if bad.isEmpty():
        return None
    texts = rows.join(bad, "digest", "left_semi")
    first = texts.groupBy("digest", "norm").agg(F.min(F.xxhash64("norm")).alias("variant"))
    return cut_lineage(texts.join(first, ["digest", "norm"]).select(F.col("digest").alias("v_digest"), F.col("doc_id").alias("v_doc"), sha256(F.col("norm")).alias("v_sha"), "variant").distinct(), "dedup-texts")
