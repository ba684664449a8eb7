"""Quality and toxicity: held-out accuracy, gradients, and the stated cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import quality as Q
from caseflow.llm import textbuf
from caseflow.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("fn,column,least", [(Q.rank, "quality", 0.98), (T.judge, "toxic", 0.9)])
def test_held_out(spark, fn, column, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.join(labels.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi")
    got = fn(spark, some, labels).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r[column] for r in got]), np.array([r.score for r in got])
    assert auc(s, y) > least and ((s >= 0) & (s <= 1)).all()


@pytest.mark.parametrize("fn,none", [(Q.rank, 0.5), (T.judge, 0.0)])
def test_cases(spark, fn, none):
    rows = [(i, ("you idiot %%% bad*** " if i % 2 else "a plain sentence here. ") * (1 + i % 5), i, "x") for i in range(60)]
    rows += [(100, None, 0, "x"), (101, "", 0, "x"), (102, "... !!!", 0, "x"), (103, "plain words here. " * 5000, 0, "x"), (None, "null id", 0, "x"), (103, "plain words here. " * 5000, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, label string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (5, None, None), (900, 1, 1)], "doc_id long, quality int, toxic int")
    got = fn(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    bad, good = (by[1], by[2]) if fn is Q.rank else (by[2], by[1])
    assert good.score > bad.score and good.predicted == 1 and bad.predicted == 0
    assert not by[None].held_out
    assert {r.score for r in fn(spark, docs, labels.limit(0)).collect()} == {none}
    assert fn(spark, docs.limit(0), labels).collect() == []
    if fn is T.judge:
        kept = T.keep_clean(spark, docs, labels)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_quality_learns_from_all_labels(spark):
    rng = np.random.default_rng(8)
    n = 9000
    bad = rng.random(n) < 0.3
    words = ["plain", "words", "Here", "some,", "good.", "BAD!", "1234", "%%%", "<b>", "of"]
    texts = [" ".join(rng.choice(words, rng.integers(3, 30))) for _ in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if b and rng.random() < 0.9 else 1) for i, b in enumerate(bad)], "doc_id long, quality int")
    got = Q.rank(spark, docs, labels).where("not held_out").join(labels, "doc_id").agg(F.expr("count_if(predicted = 0) AS p"), F.expr("count_if(quality = 0) AS q")).first()
    assert abs(got.p - got.q) <= 8  # the limit is the quantile of all labelled documents, not of some


def test_pairs_gradient_and_curvature():
    rng = np.random.default_rng(5)
    w, good, bad = rng.normal(size=4), rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    n, loss, pull, curve = Q.newton(w, good, bad)
    assert n[0] == 35
    for i in range(4):
        d = np.eye(4)[i] * 1e-5
        up, down = Q.newton(w + d, good, bad), Q.newton(w - d, good, bad)
        assert abs((up[1][0] - down[1][0]) / 2e-5 - pull[i]) < 1e-6
        assert np.allclose((up[2] - down[2]) / 2e-5, curve.reshape(4, 4)[i], atol=1e-6)


def test_gradients_of_the_network():
    rng = np.random.default_rng(4)
    m = {k: v.astype(np.float64) for k, v in T.start(1).items() if k not in ("words", "grams")}
    vec = rng.normal(size=(5, T.WORD_DIM + T.GRAM_DIM))
    win = rng.integers(-1, 5, (3, 6))
    win[:, 0] = 2
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, g, dv = T.gradients(m, vec, win, y, w)
    loss = lambda: float(np.sum(w * (np.logaddexp(0, s := T.forward(m, T.gate_tables(m, vec), win)) - y * s)))
    for name, a, grad in [*((k, m[k], g[k]) for k in g), ("vec", vec, dv)]:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-3
            up = loss()
            a[at] = old - 1e-3
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 5e-3 * max(1, abs(grad[at])), name


def test_windows_cover_every_word():
    words = [f"w{i}" for i in range(100)]
    x = T.Inputs(*textbuf.buffers(pa.array([" ".join(words[:n]) for n in (0, 1, 31, 32, 33, 48, 49, 100)])))
    win, text = x.windows()
    assert set(text) == set(range(8))
    for t, n in enumerate((0, 1, 31, 32, 33, 48, 49, 100)):
        own = win[text == t]
        assert len({v for v in own.ravel() if v >= 0}) == n
        assert len(own) == 1 or all(len(set(a) & set(b) - {-1}) > 0 for a, b in zip(own, own[1:]))
