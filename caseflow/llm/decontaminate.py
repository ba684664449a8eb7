"""Benchmark passages in documents, found by an FM-index of each shard of the documents.

A shard is a slice of a batch. Its words become symbols: those of the benchmark's vocabulary get one each, any other word is a
separator, and runs too short for the shortest window are left out, since no window lies in them. Windows are searched
backwards, their occurrences located and merged into spans. The benchmark's windows lie in blocks of bounded size, each a file of
the shared folder that a task wrote; a task that searches holds one block at a time, and the spans of all blocks are merged before
anything is done with them, so results do not depend on how items fall into blocks. No document is shuffled.

Defined results: null and wordless texts have no words and no hits; an item without words occurs nowhere; a null item_id is
written as an empty string; repeated items and rows count each for itself (item ids as a set); an empty benchmark gives no hits;
extra columns are left out.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .common import cut_lineage, map_batches, scratch_path
from .fm_index import FMIndex

WINDOW = 10
#: Characters of the benchmark in one block (the memory of a task grows with it).
BLOCK_CHARS = 4_000_000
#: Bytes of text in one shard (the memory of a task grows with it).
SHARD = 2 << 20


def blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Files of the distinct windows of each block of items, built and written by Spark tasks. Blocks without windows are left out."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = bench.agg(F.sum(F.length("text") + 20)).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    folder = scratch_path(benchmark.sparkSession, "benchmark-blocks")

    def build(table):
        block, files = _block(table["item_id"].to_pylist(), table["text"].combine_chunks(), window), []
        if len(block["patterns"]):
            files.append(f"{folder}/{uuid.uuid4().hex}")  # files of lost or repeated attempts are not in the table
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{files[0].rpartition('/')[2]}") as out:
                out.write(pickle.dumps(block, protocol=5))
        return pa.table({"file": pa.array(files, pa.string())})

    dealt = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(n, "block")
    made = cut_lineage(dealt.groupBy("block").applyInArrow(build, "file string"), "benchmark-files")
    return sorted(r["file"] for r in made.collect())


#: The block that this worker read last, by its file.
_held: dict[str, dict] = {}


def _load(file: str) -> dict:
    if file not in _held:
        _held.clear()
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_stream(path) as stream:
            _held[file] = pickle.loads(stream.read())
    return _held[file]


def _block(items: list[str], texts: pa.Array, window: int) -> dict:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    data, offsets = textbuf.buffers(texts)
    hashes, bounds, _, _ = textbuf.words(data, offsets, textbuf.ALNUM)
    vocab = np.unique(hashes)
    symbols = np.searchsorted(vocab, hashes) + 1
    rows, lengths, who = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        n = min(window, b - a)
        for s in range(a, b - n + 1 if b > a else a):
            rows.append(np.concatenate([np.zeros(window - n, np.int64), symbols[s : s + n]]))
            lengths.append(n)
            who.append(i)
    if not rows:
        return {"vocab": vocab, "patterns": np.zeros((0, window), np.int64), "lengths": np.zeros(0, np.int64), "items": []}
    patterns, inverse = np.unique(np.array(rows), axis=0, return_inverse=True)
    named: list[set] = [set() for _ in patterns]
    for p, i in zip(inverse.ravel(), who):
        named[p].add(items[i])
    return {"vocab": vocab, "patterns": patterns, "lengths": (patterns > 0).sum(1), "items": [sorted(x) for x in named]}


def find(hashes: np.ndarray, bounds: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every occurrence in the texts."""
    vocab, none = block["vocab"], np.zeros(0, np.int64)
    if not len(hashes) or not len(block["patterns"]):
        return none, none
    at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
    known = vocab[at] == hashes
    start = known.copy()
    start[1:] &= ~known[:-1]
    texts = bounds[:-1][bounds[:-1] < len(hashes)]
    start[texts] = known[texts]
    begin = np.flatnonzero(start)
    # a run ends before the next unknown word, the next text or the next run
    stops = np.unique(np.concatenate([np.flatnonzero(~known), bounds]))
    end = stops[np.searchsorted(stops, begin, "right")]
    long = end - begin >= block["lengths"].min()
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return none, none
    to = np.cumsum(size + 1) - 1  # where each run's separator goes
    text = np.zeros(int(to[-1]) + 1, np.int64)
    word = np.repeat(begin - np.concatenate([[0], to[:-1] + 1]), size + 1) + np.arange(len(text))
    inside = np.ones(len(text), bool)
    inside[to] = False
    text[inside] = at[word[inside]] + 1
    index = FMIndex(text, len(vocab))
    lo, hi = index.search(block["patterns"], block["lengths"])
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return none, none
    many = (hi - lo)[hit]
    rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    return word[index.locate(rows)], np.repeat(hit, many)


def _merged(first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans over n words: (hit flags, starts, ends)."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    hit = np.cumsum(edge)[:n] > 0
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return hit, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _scan(texts: pa.Array, block: dict) -> list[tuple[int, list[int], list[str], list[int]]]:
    """Per text: words, merged word spans as s, e, s, e ..., items, the same spans in bytes."""
    data, offsets = textbuf.buffers(texts)
    out = []
    for a, b in textbuf.byte_slices(offsets, SHARD):
        base = offsets[a]
        hashes, bounds, starts, ends = textbuf.words(data[base : offsets[b]], offsets[a : b + 1] - base, textbuf.ALNUM)
        word, pattern = find(hashes, bounds, block)
        text_of_word = np.searchsorted(bounds, word, "right") - 1
        gapped = word + text_of_word  # a gap after each text keeps the spans of two texts apart
        _, s, e = _merged(gapped, gapped + block["lengths"][pattern], len(hashes) + b - a)
        of = np.searchsorted(bounds + np.arange(b - a + 1), s, "right") - 1
        s, e = s - of, e - of
        pairs = np.unique(np.stack([text_of_word, pattern]), axis=1) if len(word) else np.zeros((2, 0), np.int64)
        items: dict[int, set] = {}
        for t, p in pairs.T:
            items.setdefault(int(t), set()).update(block["items"][p])
        spans: dict[int, list] = {}
        for t, x, y in zip(of.tolist(), s.tolist(), e.tolist()):
            spans.setdefault(t, []).append((x, y))
        for t in range(b - a):
            n, w0, b0 = int(bounds[t + 1] - bounds[t]), int(bounds[t]), int(offsets[a + t] - base)
            got = spans.get(t, ())
            out.append((n, [v - w0 for x in got for v in x], sorted(items.get(t, ())), [v for x, y in got for v in (int(starts[x]) - b0, int(ends[y - 1]) - b0)]))
    return out


def _scan_all(texts: pa.Array, files: list[str]) -> list[tuple[int, list[int], list[str], list[int]]]:
    """As _scan, over the blocks of all files."""
    out = None
    for file in files:
        rows = _scan(texts, _load(file))
        out = rows if out is None else [_both(x, y) for x, y in zip(out, rows)]
    return _scan(texts, _block([], pa.array([], pa.string()), WINDOW)) if out is None else out


def _both(x: tuple, y: tuple) -> tuple:
    if not x[1] or not y[1]:
        return x if x[1] else y
    spans = np.array(x[1] + y[1], np.int64).reshape(-1, 2)
    _, s, e = _merged(spans[:, 0], spans[:, 1], x[0])
    # a merged span begins where one of the two begins and ends where one ends
    first = dict(zip(x[1][::2] + y[1][::2], x[3][::2] + y[3][::2]))
    last = dict(zip(x[1][1::2] + y[1][1::2], x[3][1::2] + y[3][1::2]))
    s, e = s.tolist(), e.tolist()
    return x[0], [v for p in zip(s, e) for v in p], sorted({*x[2], *y[2]}), [v for p, q in zip(s, e) for v in (first[p], last[q])]


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): spans are merged runs of hit words as first, end, first, end ..., end exclusive."""
    files = blocks(benchmark, window, block_chars)

    def search(batch):
        rows = _scan_all(batch["text"], files)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_hit": pa.array([sum(r[1][1::2]) - sum(r[1][::2]) for r in rows], pa.int64()),
            "spans": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "items": pa.array([r[2] for r in rows], pa.list_(pa.string())),
        })

    cur = docs.select("doc_id", "text")
    return map_batches(cur, search, f"doc_id {dict(cur.dtypes)['doc_id']}, n_words long, n_hit long, spans array<long>, items array<string>")


def cut(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the hit spans taken out of text and n_chars set anew; all columns are kept, clean rows are unchanged.

    The spans of all blocks are merged and cut at once. A cut can bring words together that form a window again, so a changed
    text is searched for all blocks until it is clean. Documents of which no word is left go.
    """
    files = blocks(benchmark, window, block_chars)
    cur, order = docs, docs.columns
    if files:
        cur = map_batches(cur, _cutter(files), docs.schema)
    if files and "n_chars" in order:
        cur = cur.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cur.select(["`" + c.replace("`", "``") + "`" for c in order])


def _cutter(files: list[str]):
    def clean(batch):
        texts = batch["text"]
        rows = _scan_all(texts, files)
        dirty = [i for i, r in enumerate(rows) if r[1]]
        if not dirty:
            return batch
        changed: dict[int, str] = {}
        while dirty:
            for i in dirty:
                raw, at, parts = (changed[i] if i in changed else texts[i].as_py()).encode(), 0, []
                for s, e in zip(rows[i][3][::2], rows[i][3][1::2]):
                    parts.append(raw[at:s])
                    at = e
                changed[i] = b"".join([*parts, raw[at:]]).decode()
            again = _scan_all(pa.array([changed[i] for i in dirty], pa.string()), files)
            rows = dict(zip(dirty, again))
            dirty = [i for i in dirty if rows[i][1]]
            left = {i: r[0] for i, r in rows.items()}
            for i, n in left.items():
                if not n:
                    changed[i] = ""
        new = [changed.get(i, t) for i, t in enumerate(texts.to_pylist())]
        keep = pa.array([changed.get(i) != "" for i in range(len(new))])
        return batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, texts.type)).filter(keep)

    return clean
