"""Groups against a plain grouping, the filter, digests that collide, and the stated cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup as E
from caseflow.llm import fuse_filter


def strip(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(strip(t), []).append((-len(t or ""), d is None, d or 0))
    out = []
    for d, t in docs:
        best = min(groups[strip(t)])
        out.append((d, None if best[1] else best[2], len(groups[strip(t)]), hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (None, "null id"), (None, "nullid"), (7, "x" * 200_000), (8, "x" * 200_000 + " "), (9, "é é"), (10, "éé")] + [(100 + i, f"t {i % 30}") for i in range(90)]


def test_cases(spark):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in DOCS], "doc_id long, text string, n int, digest string").repartition(4)
    want, groups = brute(DOCS)
    for snapshot in (None, F.lit(True), F.lit(False)):
        rows = E.dedup(df, snapshot).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want
        assert sum(r.kept for r in rows) == groups and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert E.dedup(df.limit(0)).collect() == []


def test_colliding_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    weak = lambda norm: F.substring(E.sha256(norm), 1, 1)
    rows = E.dedup(df, None, weak).collect()
    want, groups = brute(DOCS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want and sum(r.kept for r in rows) == groups


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = fuse_filter.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse_filter.contains(f, keys).all()
        assert fuse_filter.contains(f, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 1e-3
