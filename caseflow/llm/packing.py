"""Packing by cutting-stock column generation.

Documents become token ids (by the tokenizers library) with id 0 at the end. What a document has in full sequences is cut off;
the rest, under one sequence, is a piece of some length. Only the histogram of these lengths goes to the driver: a linear
program covers it by patterns (how many pieces of each length share a sequence), a knapsack dynamic program prices new
patterns, and the solution is rounded. Patterns are then laid out over the pieces ranked within their length, by a join.

Defined results: a null or empty text is one piece with id 0 alone; repeated rows are documents of their own; an empty table
gives no rows; extra columns are left out. The ids of a piece are hashed where they are made; no ids are moved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encode, textbuf
from .common import cut_lineage

CAPACITY = 1024
END_ID = 0
#: Columns that are generated at most, and the share of the bound at which generating ends. Both bound the driver's time; any
#: set of patterns covers all pieces.
MOST_COLUMNS, GAP = 600, 1e-3
PATTERNS_EACH = 24  # that one run of the dynamic program gives


def price(values: np.ndarray, sizes: np.ndarray, capacity: int, most: np.ndarray, several: int = 1) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack: the best value, and how often it takes each size, for the full and the next smaller capacities."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.flatnonzero(values > 1e-12)
    ids = worth[np.argsort(sizes[worth])]
    s, v = sizes[ids], values[ids]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = best[c - s[:k]] + v[:k]
            j = gain.argmax()
            if gain[j] > best[c] + 1e-12:
                best[c], took[c] = gain[j], j
    out = []
    for c in range(capacity, max(capacity - several, 0), -1):
        pattern = np.zeros(len(sizes), np.int64)
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                pattern[ids[took[c]]] += 1
                c -= s[took[c]]
        out.append(np.minimum(pattern, most))
    return float(best[capacity]), out


def greedy(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that use up the histogram: largest lengths first, each pattern as often as it goes."""
    left, out = counts.copy(), []
    order = np.argsort(-sizes)
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        live = order[left[order] > 0]
        for i in live:
            if sizes[i] <= room:
                k = min(room // sizes[i], left[i])
                pattern[i], room = k, room - k * sizes[i]
            if not room:
                break
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


def solve(counts: np.ndarray, sizes: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns that cover exactly `counts` pieces of each size."""
    m = len(sizes)
    if not m:
        return []
    # a first basis: every size alone, as often as it fits
    fit = capacity // sizes
    basis = [np.bincount([i], minlength=m) * fit[i] for i in range(m)]
    cost, inverse, x = np.ones(m), np.diag(1.0 / fit), counts / fit
    duals = cost @ inverse
    ready = [p for p, _ in greedy(counts, sizes, capacity)]
    columns = 0
    while columns < MOST_COLUMNS:
        entered = 0
        for p in ready:
            if float(duals @ p) > 1 + GAP:
                _enter(basis, cost, inverse, x, p, 1.0)
                duals, entered = cost @ inverse, entered + 1
        if not entered and (i := int(duals.argmin())) < m and duals[i] < -GAP / m:
            _enter(basis, cost, inverse, x, -np.bincount([i], minlength=m), 0.0)  # more of a size than asked for
            duals, entered = cost @ inverse, 1
        value, ready = price(np.maximum(duals, 0), sizes, capacity, counts, PATTERNS_EACH)
        columns += max(entered, 1)
        if value <= 1 + GAP and duals.min() >= -GAP / m:
            break
    whole = [(p, int(np.floor(t + 1e-9))) for p, t, c in zip(basis, x, cost) if c]
    left, out = counts.copy(), []
    for p, t in sorted(whole, key=lambda y: -y[1]):
        if p.any():
            t = min(t, int((left[p > 0] // p[p > 0]).min()))
        if t > 0 and p.any():
            left -= p * t
            out.append((p, t))
    return out + greedy(left, sizes, capacity)


def _enter(basis: list, cost: np.ndarray, inverse: np.ndarray, x: np.ndarray, column: np.ndarray, price_of: float) -> None:
    """One step of the revised simplex method: column enters, all is updated in place."""
    step = inverse @ column
    able = step > 1e-9
    if not able.any():
        return
    ratio = np.full(len(x), np.inf)
    ratio[able] = np.maximum(x[able], 0) / step[able]
    r = int(np.argmin(ratio))
    theta, row = ratio[r], inverse[r] / step[r]
    inverse -= np.outer(step, row)
    inverse[r] = row
    x -= theta * step
    x[r] = theta
    basis[r], cost[r] = column, price_of


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth): full sequences and one rest per document, written once.

    part and nth number the pieces of one length within the task that wrote them.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encode.encoder(path)
        for batch in batches:
            data, offsets = textbuf.buffers(batch["text"])
            for a, b in textbuf.byte_slices(offsets, 8 << 20):
                ids, bounds = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                who, start, length, crc, total = [], [], [], [], []
                for i in range(b - a):
                    doc = np.append(ids[bounds[i] : bounds[i + 1]], END_ID).astype("<u4")
                    for s in range(0, len(doc), capacity):
                        piece = doc[s : s + capacity]
                        who.append(a + i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(doc))
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].take(pa.array(who)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()), "part": pa.array([part] * len(who), pa.int64()), "nth": pa.array(nth),
                })

    cut = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")
    return cut_lineage(cut, "packing-pieces")


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """((length, from_rank, to_rank, per_sequence, first_sequence, offset) ..., sequences): where the pieces of each rank go."""
    sizes = np.array(sorted(k for k in histogram if k < capacity), np.int64)
    counts = np.array([histogram[k] for k in sizes.tolist()], np.int64)
    ranks, sequence, out = dict.fromkeys(histogram, 0), 0, []
    patterns = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    patterns += [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, t) for p, t in solve(counts, sizes, capacity)]
    for pattern, times in patterns:
        offset = 0
        for length, per in sorted(pattern.items(), reverse=True):
            out.append((length, ranks[length], ranks[length] + per * times, per, sequence, offset))
            ranks[length] += per * times
            offset += per * length
        sequence += times
    return out, sequence


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs (doc_id, text)."""
    cut = pieces(docs, path or encode.vocabulary(), capacity)
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per_task = cut_lineage(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-ranks")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = layout(histogram, capacity)
    plan = spark.createDataFrame(plan, "length long, from_rank long, to_rank long, per long, first_sequence long, place long")
    # every (length, task) covers a run of ranks: it meets few patterns, so ranges are joined first and pieces after
    runs = per_task.join(F.broadcast(plan), "length").where("from_rank < base + n and to_rank > base").groupBy("length", "part", "base").agg(
        F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "per", "first_sequence", "place"))).alias("runs"))
    ranked = cut.join(runs, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    hit = F.filter("runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["to_rank"]))[0]
    placed = ranked.withColumn("r", hit).withColumn("k", F.col("rank") - F.col("r.from_rank"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("r.first_sequence") + F.expr("k div r.per")).alias("sequence_id"), (F.col("r.place") + F.expr("k % r.per") * F.col("length")).alias("offset"),
    )
