"""The corpus pipeline over `documents`: every stage is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import stages
from caseflow.llm.common import scratch_path, ship
from caseflow.session import drop_scratch

STAGES = [
    ("toxicity", stages.toxic),
    ("exact dedup", stages.exact),
    ("near dedup", stages.near),
    ("decontamination", stages.decontaminated),
    ("packing", stages.packed),
]
#: The network and packing have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, as rows of a written table.

    Null, empty and repeated rows, ties and extra columns are treated as the stages state; an empty table gives no rows. A stage deletes
    what earlier ones kept, and its input is deleted once its output is written.
    """
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
