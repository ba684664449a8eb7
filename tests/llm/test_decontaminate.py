"""Window hits against a plain search, cutting, and the stated cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import decontaminate as D
from caseflow.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, window=10):
    pats = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            pats.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, items = set(), set()
        for n in {len(p) for p in pats}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in pats:
                    hit |= set(range(i, i + n))
                    items |= pats[k]
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    text[::37] = 0
    text = np.append(text, 0)
    index = FMIndex(text, 3)
    assert sorted(suffix_array(text)) == list(range(len(text)))
    for n in (1, 2, 3, 5):
        pats = np.array(np.meshgrid(*[[1, 2, 3]] * n)).reshape(n, -1).T
        lo, hi = index.search(pats, np.full(len(pats), n))
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


DOCS = [
    (1, "a b c d e f g h i j k l m"), (2, None), (3, ""), (4, "!!! ..."), (5, "x A, b\nC d E f g h i J y"), (6, "short one"), (6, "short one"),
    (7, "short one short one ONE"), (None, "a b c d e f g h i j"), (8, "b c d e f g h i j k l"), (9, "é1 ñ2 ü3 " * 5), (10, "w" * 5000 + " short one"),
    (11, "a b c d e f g h i j a b c d e f g h i j"), (12, "a b c d e f g"), (13, "h i j k l m n o"),
]
BENCH = [(1, "A b c d e f g h i j"), (2, "b c d e f g h i j k l m n"), (3, "Short. One"), (10, "short one"), (4, None), (5, "?"), (None, "é1 ñ2 ü3 é1"), (3, "one short")]


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_small_cases(spark, chars):
    docs = spark.createDataFrame([(d, t, "src", 7) for d, t in DOCS], "doc_id long, text string, items string, spans int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = D.contamination(spark, docs, bench, block_chars=chars).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in rows), key=str)
    assert got == brute(DOCS, BENCH)
    clean = D.cut(spark, docs, bench, block_chars=chars)
    assert clean.columns == docs.columns
    after = [(r.doc_id, r.text) for r in clean.collect()]
    assert all(x[2] == 0 for x in brute(after, BENCH)) or chars < 100
    untouched = {d: t for (d, t), b in zip(DOCS, [brute([x], BENCH)[0] for x in DOCS]) if b[2] == 0}
    assert {d: t for d, t in after if d in untouched} == untouched


def test_cut_does_not_depend_on_blocks(spark):
    """Overlapping items of different blocks, a cut that joins a window of another block, and the small cases."""
    w = [f"w{i}" for i in range(40)]
    text = lambda a, b: " ".join(w[a:b])
    overlap = ([(1, text(0, 20)), (2, "x " + text(0, 20) + " y")], [(i, text(a, a + 15)) for i, a in enumerate(range(6))])
    joined = ([(1, text(0, 5) + " " + text(20, 35) + " " + text(5, 10) + " end")], [(i, text(20 + i, 30 + i)) for i in range(6)] + [(9, text(0, 10))])
    for docs, items in (overlap, joined, (DOCS, BENCH)):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert len(D.blocks(bench, block_chars=15)) > 1
        got = [sorted(((r.doc_id, r.text) for r in D.cut(spark, frame, bench, block_chars=n).collect()), key=str) for n in (4_000_000, 60, 15)]
        assert got[0] == got[1] == got[2]
        assert all(x[2] == 0 for x in brute(got[0], items))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(spark, docs, bench).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.contamination(spark, some, bench).collect()] == [(2, 0, [])]
    assert D.cut(spark, some, bench).collect() == some.collect()


def test_shards_and_tables(spark, monkeypatch):
    """Whole tables at sf0.001 against the plain search, with shards of a few documents."""
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = D.contamination(spark, docs, bench).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in rows), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want and any(x[2] for x in want)
    block = D._block([str(r.item_id) for r in bench.collect()], pa.array([r.text for r in bench.collect()]), 10)
    texts = pa.array([r.text for r in docs.collect()])
    big = D._scan(texts, block)
    monkeypatch.setattr(D, "SHARD", 3000)
    assert D._scan(texts, block) == big


def test_a_batch_is_cut_with_little_memory():
    import tracemalloc

    from caseflow.llm import decontaminate as D

    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(5_000)]
    text = lambda n: " ".join(word[i] for i in rng.integers(0, 5_000, n))
    D._held["block"] = D._block(["a"], pa.array([text(200)]), D.WINDOW)
    batch = pa.record_batch({"text": [text(2_000)] * 1_500})  # 16 MB
    tracemalloc.start()
    D._cutter(["block"])(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    D._held.clear()
    print(peak)
    assert peak < 75 << 20
