"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns documents with all their columns, the last one pieces of sequences.

Rows are dropped by a join with the ids that go. Repeated rows are rows of one id; where only some of them go, the
rows of that id are told apart by content, and equal ones are one row. Columns beside doc_id and text may have any name and type.

A stage keeps its intermediate tables in a folder of its own. Write its result before calling the next stage: that one deletes the
folders of earlier stages, unless its docs still read from them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_scope
from .common import cut_lineage, read, ship

#: Ids that are sent to all executors at most; more go through a shuffle join.
BROADCAST_IDS = 500_000

#: Folders of stages that have run, by application.
_folders: dict[str, list[str]] = {}


def _stage(fn: Callable) -> Callable:
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        mine = _folders.setdefault(spark.sparkContext.applicationId, [])
        files = docs.inputFiles() if mine else []
        for name in [n for n in mine if not any(n in f for f in files)]:
            drop_scratch(spark, name)
            mine.remove(name)
        with scratch_scope(f"stage-{fn.__name__}") as name:
            mine.append(name)
            return fn(spark, docs, sf_dir)

    return run


def _small(df: DataFrame) -> DataFrame:
    df = cut_lineage(df, "stage-ids")
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, case ignored."""
    taken = "".join(c.lower() for c in docs.columns)
    lead = "_"
    while lead in taken:
        lead += "_"
    return [lead + n for n in names]


def _all(docs: DataFrame) -> list[Column]:
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def _one_each(rows: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys: one of the longest text."""
    row, size = _free(docs, "row", "size")
    packed = rows.select(*keys, F.struct(F.length("text"), "text").alias(size), F.struct(*_all(rows)[: len(docs.columns)]).alias(row))
    return packed.groupBy(*keys).agg(F.max_by(row, size).alias(row)).select(f"{row}.*")


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go."""
    from .toxicity import keep_clean

    return keep_clean(spark, docs, read(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    from .exact_dedup import dedup, normalised, sha256

    id_, sha, own_sha = _free(docs, "id", "sha", "own")
    decided = cut_lineage(dedup(docs.select("doc_id", "text")).select(F.col("doc_id").alias(id_), "kept", F.col("text_sha256").alias(sha)), "stage-exact")
    per_id = decided.groupBy(id_).agg(F.min("kept").alias("all"), F.max("kept").alias("any"))
    gone = _small(per_id.where("not any").select(id_))
    mixed = _small(per_id.where("any and not all").select(id_))
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    left = docs.join(gone, same, "left_anti")
    if mixed.isEmpty():
        return left
    # an id of which some rows stay: the rows of a kept text, one for each
    kept = decided.where("kept").join(mixed.withColumnRenamed(id_, own_sha), F.col(id_).eqNullSafe(F.col(own_sha)), "left_semi").select(id_, sha).distinct()
    own = left.join(mixed, same, "left_semi").withColumn(own_sha, sha256(normalised(F.col("text"))))
    own = own.join(kept, same & (F.col(own_sha) == F.col(sha)), "left_semi")
    return left.join(mixed, same, "left_anti").unionByName(_one_each(own, docs, ["doc_id", own_sha]))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, of its smallest id."""
    from .common import map_batches
    from .near_dedup import decide, digests

    id_, *key = _free(docs, "id", "n", "s1", "s2")
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    decided = decide(docs.select("doc_id", "text")).select(F.col("doc_id").alias(id_), *(F.col(c).alias(k) for c, k in zip(("n_shingles", "s1", "s2"), key)), "kept")
    decided = cut_lineage(decided, "stage-near")
    gone = _small(decided.where("not kept").select(id_).distinct())
    other = gone.withColumnRenamed(id_, "other")
    mixed = _small(decided.where("kept").join(other, F.col(id_).eqNullSafe(F.col("other")), "left_semi").select(id_).distinct())
    left = docs.join(gone, same, "left_anti")
    if mixed.isEmpty():
        return left
    # an id of which some rows stay: its rows without words, and one row of each kept set
    schema = ", ".join("`" + n.replace("`", "``") + f"` {t}" for n, t in [*docs.dtypes, *((k, "long") for k in key)])
    columns = [*docs.columns, *key]
    names = lambda batch: digests(batch.rename_columns([f"c{i}" if c != "text" else c for i, c in enumerate(batch.schema.names)])).rename_columns(columns)
    own = cut_lineage(map_batches(docs.join(mixed, same, "left_semi"), names, schema), "stage-mixed")
    other = mixed.withColumnRenamed(id_, "other")
    kept = decided.where(f"kept and {key[0]} > 0").join(other, F.col(id_).eqNullSafe(F.col("other")), "left_semi").select(id_, *(F.col(k).alias(f"{k}_k") for k in key))
    match = same
    for k in key:
        match = match & (F.col(k) == F.col(f"{k}_k"))
    full = own.where(F.col(key[0]) > 0).join(kept, match, "left_semi")
    without = own.where(F.col(key[0]) == 0).drop(*key)
    return left.unionByName(without).unionByName(_one_each(full, docs, ["doc_id", *key]))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents of which no word is left go."""
    from .decontaminate import cut

    return cut(spark, docs, read(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    from .packing import pack

    return pack(spark, docs)
