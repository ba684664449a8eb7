"""Candidate documents against brute force, whatever the blocks, and what is written on the way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from caseflow import session
from caseflow.functions import dice
from caseflow.operators import candidates as C
from caseflow.operators import match as M

FIELDS = {"recipient_name": 3.0, "reason": 2.0, "class_year": 0.5}
KIND = "id long, fname string, filename string, sha1 string, form_type string, recipient_name string, reason string, class_year string"


def rows(rng, first, n):
    out = []
    for i in range(n):
        name = rng.choice(["ann lee smith", "ann lea smith", "an lee", "bob stone", "", "a", "aaaaaaa" * rng.choice([1, 60]), None])
        reason = rng.choice(["late for drill", "late drill", "absent", "", "b", "late 77"])
        key = rng.choice([f"{name} {reason}", "same file", "", "x"])
        out.append((first + i, key, rng.choice(["a.pdf", "b.pdf", "Zé.pdf", None]), rng.choice(["h1", "h2", "h3", None, f"own{first + i}"]), rng.choice(["F10", "F174", "", None]), name, reason, rng.choice(["2026", "2027", "é", ""])))
    return out


def brute(items, cases, sent, not_self, floor=0.3, top=6):
    pairs = items.select(*[F.col(c).alias(f"i_{c}") for c in items.columns]).crossJoin(cases.select(*[F.col(c).alias(f"c_{c}") for c in cases.columns]))
    d = {f: dice(f"i_{f}", f"c_{f}") for f in ("fname", *FIELDS)}
    for side in "ic":
        pairs = pairs.fillna("", [f"{side}_{f}" for f in d])
    pairs = pairs.select("*", M._score(FIELDS, d).alias("raw")).join(sent.select(F.col("case_id").alias("c_id"), F.col("step").alias("i_step"), F.lit(True).alias("sent")), ["c_id", "i_step"], "left")
    raw = F.when(F.col("i_sha1") == F.col("c_sha1"), 1.0).when(F.col("sent") & (F.col("i_kind") == "returned"), F.least(F.lit(1.0), F.col("raw") + 0.15)).otherwise(F.col("raw"))
    got = {}
    for r in pairs.withColumn("raw", raw).where(F.col("raw") >= floor).collect():
        if not not_self or r.i_id != r.c_id:
            got.setdefault(r.i_id, []).append((-int(r.raw * 100 + 0.5), r.c_filename is not None, r.c_filename or "", r.c_id))
    return {i: [(c[3], -c[0]) for c in sorted(v)[:top]] for i, v in got.items()}


@pytest.mark.parametrize("block, at_once, not_self", [(1, 2048, True), (400, 7, False), (2_000_000, 5, True)])
def test_candidates_equal_brute_force(spark, monkeypatch, block, at_once, not_self):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "AT_ONCE", at_once)
    rng = random.Random(block)
    n = 12 if block == 1 else 60
    items = spark.createDataFrame([(*r, rng.choice(["returned", "found"]), rng.choice(["s1", "s2", None])) for r in rows(rng, 0, 40)], KIND + ", kind string, step string")
    cases = spark.createDataFrame(rows(rng, 20, n), KIND)
    sent = spark.createDataFrame([(20 + i, s) for i in range(n) for s in ("s1", "s2", "s3") if rng.random() < 0.3], "case_id long, step string")
    got = {}
    for r in M.document_candidates(items, cases, FIELDS, ["recipient_name", "reason"], sent=sent, not_self=not_self).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.case_id, round(r.score * 100)))
    want = brute(items, cases, sent, not_self)
    assert got == want and sum(map(len, want.values())) > 50


def test_no_row_per_pair_is_written(spark):
    """80 items alike 80 cases are 6,400 pairs, of which the 6 best of each item are kept."""
    row = lambda i: (i, "ann lee late", f"{i:03}.pdf", f"h{i}", "F10", "ann lee", "late", "2026")
    items, cases = (spark.createDataFrame([row(first + i) for i in range(80)], KIND) for first in (0, 100))
    folder = session._own_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = M.document_candidates(items, cases, FIELDS, ["recipient_name", "reason"])
    assert {r.item_id: r.n for r in got.groupBy("item_id").agg(F.count("*").alias("n"), F.max("case_id")).collect()} == {i: 6 for i in range(80)}
    assert got.where("case_id > 105").count() == 0
    made = [spark.read.parquet(f"{folder}/{t}").count() for t in set(os.listdir(folder)) - before]
    assert made and max(made) <= 6 * 80


def test_tables_without_rows(spark):
    some, none = spark.createDataFrame([(1, "a b", "a.pdf", "h", "F10", "a b", "c d", "")], KIND), spark.createDataFrame([], KIND)
    for items, cases in ((some, none), (none, some)):
        assert M.document_candidates(items, cases, FIELDS, ["recipient_name", "reason"]).collect() == []


def test_suggestions_equal_their_sql(spark, monkeypatch):
    """Whatever the blocks, one row a page."""
    from caseflow.plans import load_queries
    from oracle import compare, connect

    monkeypatch.setattr(C, "BLOCK", 3000)
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), load_queries()["match_suggestions"], sf) == ""
