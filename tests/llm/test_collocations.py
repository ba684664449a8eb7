"""Phrases against plain counting, the summaries' guarantee, and the query against its SQL."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import collocations as C


def plain(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))] if len(p) == 2 else []
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_small_texts(spark):
    rng = random.Random(4)
    words = ["a", "B", "b", "neé", "É", "\x00z", "x-y", " ", "the"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " .,"), ("fr", "one two three"), ("long", "new york city " * 20_000)] + [("en", "hot pair here.")] * 300
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string").repartition(5)
    assert got(C.collocations(spark, df)) == plain(rows)
    assert got(C.collocations(spark, df, least=3, top=7)) == plain(rows, 3, 7)
    assert C.collocations(spark, df.limit(0)).collect() == []


@pytest.mark.parametrize("slices", [1, 7, 60])
def test_every_frequent_key_survives(slices):
    rng = np.random.default_rng(slices)
    values = np.concatenate([np.repeat(rng.integers(0, 2**63, 400), 10), rng.integers(0, 2**63, 30_000), np.repeat(rng.integers(0, 2**63, 2_000), 4), np.full(5_000, 77)]).astype(np.uint64)
    rng.shuffle(values)
    capacity = len(values) // 10 + 1
    s = C.Summary(capacity)
    for part in np.array_split(values, slices):
        s.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint64, np.int64))))
        s.settle()
        assert len(s.keys) <= capacity
    keys, n = np.unique(values, return_counts=True)
    assert set(keys[n >= 10]) <= set(s.survivors(10)) and s.off < 10


def test_products_beyond_64_bits(spark, monkeypatch):
    rows = [("x", 0, "", 9 * 10**12), ("x", 1, "a", 3 * 10**12), ("x", 1, "b", 2 * 10**12 + 1), ("x", 2, "a b", 10**12 + 7)]
    table = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(C, "counts", lambda *_: table)
    a, left, right = 10**12 + 7, 3 * 10**12, 2 * 10**12 + 1
    assert got(C.collocations(spark, None)) == [("x", 1, "a b", a, left, right, 9 * 10**12, 10**6 * a * a // (left * right))]


def test_query_equals_its_sql(spark):
    import duckdb

    from caseflow.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = db.execute(SQL["op12_collocations"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in cur.fetchall())
    assert got(QUERIES["op12_collocations"](spark, sf)) == want and len(want) > 1000


def test_a_slice_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 20_000, 2_000))
    batch = pa.record_batch({"lang": ["en"] * 1_200, "text": [text] * 1_200})  # 13 MB
    tracemalloc.start()
    for _, part in C._slices(batch):
        part.pairs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20


def test_memory_of_a_slice():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(5_000)) for _ in range(240)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    tracemalloc.start()
    try:
        for _, part in C._slices(batch):
            left, right, n, _ = part.pairs()
            C._sent(part.keys(left, right), n, 64)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 6 << 20 and most < 80 << 20
