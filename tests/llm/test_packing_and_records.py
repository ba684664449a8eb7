"""Packing and record files against ids taken straight from the library."""

import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseflow.llm import encode, packing, record_file

LIB = Tokenizer.from_file(encode.vocabulary())
LIB.encode_special_tokens = True
DOCS = [(3, "a b c"), (1, None), (2, ""), (2, ""), (None, "null id"), (4, "word " * 3000), (5, "<|endoftext|> x"), (5, "<|endoftext|> x"), (-7, "é" * 900)] + [(100 + i, f"doc {i} " * (i % 300)) for i in range(400)]


def frame_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, start int, file string").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def check(rows, docs):
    want = {}
    for d, t in docs:
        ids = LIB.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault((d, len(ids)), []).append(ids)
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(by) == set(want)
    for k, docs_ids in want.items():
        spans = sorted((r.start, r.length, r.ids_crc32) for r in by[k])
        got = [x for x in spans]
        expect = sorted((s, min(1024, len(ids) - s), crc(ids[s : s + 1024])) for ids in docs_ids for s in range(0, len(ids), 1024))
        assert got == expect
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    used = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        used += at
    return used, len(seqs) * 1024


def test_packing_cases(spark):
    used, room = check(packing.pack(spark, frame_of(spark, DOCS)).collect(), DOCS)
    assert used > 0.97 * room
    assert packing.pack(spark, frame_of(spark, [(1, "x")]).where("doc_id = 2")).collect() == []


def test_packing_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, room = check(packing.pack(spark, docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used > 0.97 * room


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_a_histogram(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 1024), [1, 30, 400, 1023][seed], replace=False))
    counts = rng.integers(1, 5000, len(sizes))
    out = packing.solve(counts, sizes)
    assert (sum(p * t for p, t in out) == counts).all()
    assert all((p * sizes).sum() <= 1024 for p, _ in out)
    assert sum(t for _, t in out) <= sum(t for _, t in packing.greedy(counts, sizes, 1024)) + 5


def test_column_generation_beats_largest_first():
    """Largest first fills two sequences with 600 + 400 and leaves 350s badly placed; patterns know better."""
    sizes, counts = np.array([240, 260, 340, 400, 524]), np.array([900, 600, 600, 300, 300])
    assert sum(t for _, t in packing.solve(counts, sizes)) <= sum(t for _, t in packing.greedy(counts, sizes, 1024))
    assert sum(t for _, t in packing.solve(counts, sizes)) <= -(-int(counts @ sizes) // 1024) * 1.05


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(5)
    sizes, values = np.array([3, 5, 7, 11]), rng.random(4)
    best = max(values @ np.array([a, b, c, d]) for a in range(9) for b in range(6) for c in range(4) for d in range(3) if np.array([a, b, c, d]) @ sizes <= 24)
    got, (pattern, smaller) = packing.price(values, sizes, 24, np.full(4, 99), 2)
    assert smaller @ sizes <= 23
    assert abs(got - best) < 1e-9 and pattern @ sizes <= 24 and abs(pattern @ values - best) < 1e-9


def test_records_round_trip(spark, tmp_path):
    files = record_file.write(frame_of(spark, DOCS), f"file://{tmp_path}", encode.vocabulary(), file_bytes=20_000)
    rows = record_file.read_back(files).collect()
    start, want = 0, []
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = LIB.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    first = files.orderBy("task", "seq").first()
    some = record_file.read_some(first["file"], [2, 0])
    assert [d for d, _ in some] == [want[2][0], want[0][0]] and crc(some[0][1]) == want[2][3]
    assert files.count() > 3
    assert record_file.round_trip(spark, frame_of(spark, DOCS).limit(0)).collect() == []


def test_broken_records_are_noticed():
    raw = bytearray(record_file.frame(b"abc") + record_file.frame(b""))
    stream = io.BytesIO(bytes(raw))
    assert [record_file.unframe(stream) for _ in range(3)] == [b"abc", b"", None]
    for i in (0, 9, 13, 16):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            record_file.unframe(io.BytesIO(bytes(bad)))
