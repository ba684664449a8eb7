"""Every stage against a brute-force version of it on its own input, and whole runs."""

import importlib
import sys
import os

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as P  # noqa: E402
from caseflow.llm import stages, toxicity  # noqa: E402
from test_decontaminate import brute as leaks  # noqa: E402
from test_near_dedup import brute as near  # noqa: E402
from test_packing_and_records import check  # noqa: E402

SF = "/root/testdata/sf0.001"


def strip(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_on_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    for i, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = f"file://{tmp_path}/{i}"
        stage(spark, docs, SF).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if name == "toxicity":
            verdict = {r.doc_id: r.predicted for r in toxicity.judge(spark, spark.createDataFrame(before, "doc_id long, text string"), labels).collect()}
            assert set(after) == {d for d, v in verdict.items() if not v} and len(after) > 0.7 * len(before)
        elif name == "exact dedup":
            best = {}
            for d, t in before:
                k = strip(t)
                best[k] = min(best.get(k, (1, 0)), (-len(t or ""), d))
            assert set(after) == {d for _, d in best.values()} and len(after) < len(before)
        elif name == "near dedup":
            assert set(after) == {d for d, _, _, kept in near(before) if kept}
        elif name == "decontamination":
            dirty = {x[0] for x in leaks(before, bench) if x[2]}
            assert dirty and all(x[2] == 0 for x in leaks(list(after.items()), bench))
            assert all(after[d] == t for d, t in before if d not in dirty)
            assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in dirty)
        else:
            used, room = check(rows, before)
            assert used > 0.95 * room


ROWS = [(1, "a b c d"), (1, "a b c d"), (1, " a b c d"), (2, None), (3, ""), (None, "only one"), (None, "a b c d"), (4, "other text here now"), (4, "quite another text here")]


def test_exact_stage_with_repeated_ids(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in stages.exact(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, " a b c d"), (2, None), (None, "only one"), (4, "other text here now"), (4, "quite another text here")], key=str)


def test_near_stage_with_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [
        (1, a), (None, a + " more"), (None, b), (None, b + " more"), (None, c), (None, ""), (None, None),  # null ids: a copy of 1, two copies, a clean one
        (2, d), (2, e), (0, e + " more"),  # one of the two texts of 2 goes
        (3, f), (3, f + " more"), (3, "own text"), (3, "OWN  text"),  # copies that share their smallest id
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = stages.near(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    short = [[i, (t or "-").lower().replace(" more", "").replace("  ", " ")] for i, t in got]
    assert sorted(short, key=str) == sorted([[1, a], [None, b], [None, c], [None, "-"], [None, "-"], [2, d], [0, e], [3, f], [3, "own text"]], key=str)
    assert set(got) <= set(rows)


@pytest.mark.parametrize("stage", [stages.toxic, stages.exact, stages.near, stages.decontaminated, stages.packed])
def test_empty_and_odd_tables(spark, stage):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs.limit(0), SF).collect() == []
    assert stage(spark, docs, SF).count() > 0


@pytest.mark.parametrize("stage", [stages.toxic, stages.exact, stages.near, stages.decontaminated, stages.packed])
def test_columns_of_any_name_and_type(spark, stage):
    extra = {"id": 1, "sha": "x", "n_shingles": 2, "s1": 3, "s2": 4, "kept": "k", "row": "r", "n": 5, "any": 6, "root": 7, "_id": 8, "a.b": 9}
    docs = spark.createDataFrame([(d, t, "en", *extra.values()) for d, t in ROWS], ["doc_id", "text", "lang", *extra])
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.lit("v"))).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows
    if stage is not stages.packed:
        assert out.columns == docs.columns and {r["a.b"] for r in rows} == {9} and {str(r.tags) for r in rows} == {"{'k': 'v'}"}


def test_a_stage_deletes_what_earlier_ones_left(spark, tmp_path):
    work = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/scratch-{spark.sparkContext.applicationId}"
    docs = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(3)
    first = stages.exact(spark, docs, SF)
    before = {x for x in os.listdir(work) if x.startswith("stage-exact")}
    assert before
    second = stages.near(spark, first, SF)  # reads the first one's tables still
    assert before <= set(os.listdir(work)) and second.count() > 0
    second.write.parquet(f"file://{tmp_path}/out")
    stages.packed(spark, spark.read.parquet(f"file://{tmp_path}/out"), SF).count()
    assert {x for x in os.listdir(work) if x.startswith("stage-")} == {x for x in os.listdir(work) if x.startswith("stage-packed")}


def test_entry_registers_the_operators_and_the_pipeline():
    names = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
