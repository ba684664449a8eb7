"""Document quality by Bradley-Terry ranking.

Pairs of a better and a worse labelled document teach one weight per feature: the logistic loss of the feature difference. Every
labelled document is learned from: a hash deals them into blocks, and all pairs of a block count. Newton's steps add up gradients and
curvatures of the blocks where these lie. A document's score is its weighted feature sum, moved so that the quantile of all labelled
documents that holds the share of worse labels lies at the decision limit.

Features are computed over the whole text: shares of kinds of characters, word and line repetition, and hashed pairs of
character shapes. Defined results: a null or empty text has zero features but a score like any other; without labels of both
kinds all scores are 0.5; repeated rows score alike, repeated labels count each; an empty table gives no rows; extra columns
are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, textbuf
from .common import drop, held_out, kept, map_batches

#: Labelled documents of a block, about; a block has all its pairs of a better and a worse one. A larger block (repeated ids) is cut. Rows
#: of a block without one of the labels count for means and the quantile only.
BLOCK = 512
#: Newton's steps at most, and the largest step of a weight at which they end.
STEPS, RIDGE, STILL = 40, 1e-3, 1e-6
#: Sums of blocks are added in so many tasks before the driver has them.
SUM_TASKS = 8
#: Scores of labelled documents, from -SPAN to SPAN, are counted at so many places for their quantile, then within the place that holds it.
PLACES, SPAN, FINER = 4096, 32, 3
LIMIT = 0.3
#: Buckets of pairs of shapes, as many as there are bytes.
SHAPES = 256
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")
_KINDS = [np.isin(np.arange(256), k) for k in (
    list(range(0x41, 0x5B)), list(range(0x30, 0x3A)), [0x20], [0x0A], [0x21], [0x25, 0x24, 0x23, 0x26, 0x2A], [0x7C], [0x3C, 0x3E, 0x7B, 0x7D, 0x5B, 0x5D, 0x5C, 0x5F, 0x7E, 0x5E],
    [0x2E], [0x2C, 0x3B, 0x3A], [0x28, 0x29, 0x22, 0x27], list(range(0x80, 0x100)), [0x3D, 0x2B, 0x2F, 0x2D, 0x40, 0x3F],
)]
WIDTH = len(_KINDS) + 8 + SHAPES


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, WIDTH)."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    row = np.repeat(np.arange(n) * 256, np.diff(offsets))  # where each byte's text has its counts
    counts = np.bincount(row + data, minlength=n * 256).reshape(n, 256)
    cols = [np.sqrt(counts[:, k].sum(1) / size) for k in _KINDS]
    hashes, bounds, starts, ends = textbuf.words(data, offsets, ~textbuf.SPACE)
    count = np.maximum(1, np.diff(bounds))
    cols.append(np.log1p(np.diff(bounds)) / 10)
    cols.append(linear.segment_sums((ends - starts).astype(float), bounds) / count / 20)
    for k in (1, 3):
        h, b = textbuf.shingles(hashes, bounds, k)
        cols.append(textbuf.distinct_counts(h, b) / np.maximum(1, np.diff(b)))
    short = (ends - starts) <= 3
    cols.append(linear.segment_sums(short, bounds) / count)
    last = data[ends - 1] if len(ends) else data[:0]
    cols.append(linear.segment_sums(_SHAPE[last] != ord("a"), bounds) / count)
    no_break = np.ones(256, bool)
    no_break[0x0A] = False
    lines, at, _, _ = textbuf.words(data, offsets, no_break)
    cols.append(textbuf.distinct_counts(lines, at) / np.maximum(1, np.diff(at)))
    cols.append(np.log1p(np.diff(at)) / 5)
    shape = _SHAPE[data]
    pair = linear.gram_buckets(shape, 2, SHAPES)
    edge = offsets[1:-1] - 1  # pairs that go on into the next text don't count
    edge = np.unique(edge[(edge >= 0) & (edge < len(pair))])
    row = row[: len(pair)]
    h = np.bincount(row + pair, minlength=n * SHAPES) - np.bincount(row[edge] + pair[edge], minlength=n * SHAPES)
    h = h.reshape(n, SHAPES)
    return np.concatenate([np.stack(cols, 1), np.sqrt(h / size[:, None])], axis=1).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most `most[label]` learnable documents per label, and how many labels of each kind there are."""
    from pyspark.sql import Window as W

    given = labels.where(~held_out("doc_id", 5, 0) & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    share = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # the ids are thinned before texts are met, so that no more than the sample moves
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    order = F.row_number().over(W.partitionBy("label").orderBy(place, "doc_id"))
    upto = F.lit(0)
    for label, n in share.items():  # about three times as many as wanted, then the first of them
        upto = F.when(F.col("label") == label, F.lit(min(1 << 20, 1 + 3 * most[label] * (1 << 20) // n))).otherwise(upto)
    ids = given.where(place < upto)
    ids = ids.withColumn("rn", order).where(F.col("rn") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0])).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text")), share


def _halves(rows: pa.RecordBatch):
    """(better, worse) features of each block."""
    for good, bad in zip(rows["good"], rows["bad"]):
        yield tuple(np.frombuffer(v.as_buffer(), np.float32).reshape(-1, WIDTH).astype(float) for v in (good, bad))


def _added(blocks: DataFrame, part) -> list[np.ndarray]:
    """Arrays that `part` gives of each block's halves, summed up over all blocks: within tasks, in a few tasks, then here."""
    def own(batches):
        total = None
        for b in batches:
            for halves in _halves(b):
                got = part(*halves)
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array([float(total[-1].sum())]), "sums": pa.array([[np.asarray(x, float).tobytes() for x in total]], pa.list_(pa.binary()))})

    def both(batches):
        total = None
        for b in batches:
            for row in b["sums"]:
                got = [np.frombuffer(x.as_buffer()) for x in row]
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[x.tobytes() for x in total]], pa.list_(pa.binary()))})

    sums = blocks.select("good", "bad").mapInArrow(own, "at double, sums array<binary>")
    sums = sums.repartition(SUM_TASKS, "at").sortWithinPartitions("at").select("sums").mapInArrow(both, "sums array<binary>")
    rows = [[np.frombuffer(bytes(x)) for x in r["sums"]] for r in sums.collect()]
    return [sum(x) for x in zip(*rows)]


def newton(w: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """Pairs, loss, gradient and curvature at w of all pairs of two sets: log(1 + exp(worse - better)) of each."""
    if not len(good) or not len(bad):
        return [np.zeros(1), np.zeros(1), np.zeros(len(w)), np.zeros(len(w) ** 2)]
    gap = (bad @ w)[None, :] - (good @ w)[:, None]
    pull = linear.sigmoid(gap)
    bend = pull * (1 - pull)
    cross = good.T @ bend @ bad
    curve = (good.T * bend.sum(1)) @ good + (bad.T * bend.sum(0)) @ bad - cross - cross.T
    return [np.array([gap.size], float), np.array([np.logaddexp(0, gap).sum()]), bad.T @ pull.sum(0) - good.T @ pull.sum(1), curve.ravel()]


def train(rows: DataFrame) -> dict | None:
    """The model of all rows (doc_id, label, x). Rows lie in blocks by a hash of their id; the driver has sums of blocks only."""
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return None
    parts = 1 + sum(count.values()) // BLOCK
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(parts)))
    tasks = max(1, min(parts // 4, 2000))

    def pack(held):
        return pa.RecordBatch.from_pydict({k: pa.array([b"".join(x for v, x in held if v == want)], pa.binary()) for k, want in (("good", 1), ("bad", 0))})

    def block(batches):
        last, held = None, []
        for b in batches:
            for at, label, x in zip(b["block"], b["label"], b["x"]):
                at = at.as_py()
                if held and (at != last or len(held) >= 2 * BLOCK):
                    yield pack(held)
                    held = []
                last = at
                held.append((label.as_py(), x.as_py()))
        if held:
            yield pack(held)

    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block", F.xxhash64("x"), "label", "x").select("block", "label", "x")
    blocks = kept(dealt.mapInArrow(block, "good binary, bad binary"), "quality-blocks")
    n, total, square = _added(blocks, lambda g, b: [np.array([len(g) + len(b)], float), g.sum(0) + b.sum(0), (g * g).sum(0) + (b * b).sum(0)])
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0)) + 1e-3
    w, step, before = np.zeros(WIDTH), np.zeros(WIDTH), np.inf
    for _ in range(STEPS):
        pairs, loss, pull, curve = _added(blocks, lambda g, b, w=w: newton(w, (g - mean) / spread, (b - mean) / spread))
        if not pairs[0]:
            drop(blocks)
            return None
        loss = loss[0] / pairs[0] + RIDGE * (w @ w) / 2
        if loss > before + 1e-12:  # too far: half the step
            step = step / 2
            w = w - step
            if np.abs(step).max() < STILL:
                break
            continue
        before = loss
        step = -np.linalg.solve(curve.reshape(WIDTH, WIDTH) / pairs[0] + RIDGE * np.eye(WIDTH), pull / pairs[0] + RIDGE * w)
        w = w + step
        if np.abs(step).max() < STILL:
            break
    w = np.round(w, 9)

    low, width = -float(SPAN), 2.0 * SPAN
    for _ in range(FINER):
        def places(batches, low=low, width=width):
            tally = np.zeros(PLACES + 2, np.int64)
            for b in batches:
                for halves in _halves(b):
                    for x in halves:
                        at = np.ceil((((x - mean) / spread) @ w - low) / width * PLACES)
                        tally += np.bincount(np.clip(at, 0, PLACES + 1).astype(np.int64), minlength=len(tally))
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(tally[at])})

        counted = blocks.select("good", "bad").mapInArrow(places, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
        upto = int(np.searchsorted(np.cumsum([r["n"] for r in counted]), count[0]))
        place = min(max(counted[min(upto, len(counted) - 1)]["at"], 1), PLACES)
        low, width = low + (place - 1) * width / PLACES, width / PLACES
    drop(blocks)
    return {"mean": mean, "spread": spread, "w": w, "at": low + width}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = ((x - model["mean"]) / model["spread"]) @ model["w"] - model["at"]
    return np.clip(linear.sigmoid(s + np.log(LIMIT / (1 - LIMIT))), 0, 1)


def rank(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def rows_of(texts):
        data, offsets = textbuf.buffers(texts)
        return np.concatenate([features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textbuf.byte_slices(offsets, 4 << 20)])

    def measure(batch):
        x = rows_of(batch["text"])
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # every text is taken apart once: its features are learned from, where it has a label, and scored
    own = kept(map_batches(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), measure, f"doc_id {kind}, held_out boolean, x binary"), "quality-features")
    given = labels.where(~held_out("doc_id", 5, 0) & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    # merged at every size: sent to all tasks, ids would outgrow an executor
    rows = kept(own.where(~F.col("held_out")).select("doc_id", "x").join(given.hint("merge"), "doc_id").select("doc_id", "label", "x"), "quality-rows")
    shared = spark.sparkContext.broadcast(train(rows))
    drop(rows)

    def run(batch):
        x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
        s = score(shared.value, x)
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(s), "predicted": pa.array((s >= LIMIT).astype(np.int32), pa.int32())})

    return map_batches(own, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
