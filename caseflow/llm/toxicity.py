"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is scored by all its overlapping windows of words; its score is the highest of them. A word's input is the sum of two hashed embeddings
and the mean embedding of its hashed byte trigrams. Everything is trained in numpy: embeddings start from the labelled texts' word
counts, and each round learns from the window of every training text that scores highest at that time.

Defined results: a null, empty or wordless text is one window without words, which scores as low as the model allows; a text shorter
than a window is one padded window; without labels of both kinds all scores are 0; repeated rows score alike; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, textbuf
from .common import held_out, map_batches
from .quality import labelled

WINDOW, STRIDE = 32, 16
#: Training texts of each label at most (most errors would be clean texts, so more of these), and the characters of one beyond which it is not used for training (scoring has no limit).
SAMPLE, SAMPLE_CHARS = {0: 2100, 1: 700}, 12_000
WORDS, GRAMS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 12, 6, 4, 8
ROUNDS, EPOCHS, RATE = 4, 6, 0.01
AT_ONCE = 512


class Inputs:
    """The words of texts: distinct ones, and which word stands where."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = textbuf.LOWER[data]
        hashes, self.bounds, starts, ends = textbuf.words(low, offsets, textbuf.ALNUM, lower=False)
        self.keys, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        n = len(self.keys)
        self.one = (self.keys % np.uint64(WORDS)).astype(np.int64)
        self.two = ((self.keys >> np.uint64(32)) % np.uint64(WORDS)).astype(np.int64)
        # trigrams of each distinct word with a blank before and after
        size = (ends - starts)[first]
        at = np.concatenate([[0], np.cumsum(size + 2)])
        letters = np.full(at[-1], 0x20, np.uint8)
        put = np.repeat(at[:-1] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        letters[put] = low[np.repeat(starts[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        grams = linear.gram_buckets(letters, 3, GRAMS)
        before = np.cumsum(size) - size
        keep = np.repeat(at[:-1] - before, size) + np.arange(size.sum())  # a trigram for each letter, none across words
        self.grams, self.gram_at, self.gram_n = grams[keep], before, size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, WINDOW) numbers of distinct words, -1 for padding; and the text of each window."""
        count = np.diff(self.bounds)
        many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(count)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = (self.bounds[:-1][text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.bounds[1:][text][:, None]
        return np.where(inside, self.word[np.minimum(at, len(self.word) - 1)] if len(self.word) else -1, -1), text


def start(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.normal(0, 0.3, s)).astype(np.float32)
    m = {"words": small(WORDS, WORD_DIM) * 0.1, "grams": small(GRAMS, GRAM_DIM) * 0.1, "v": small(2 * HIDDEN), "w": small(2 * HIDDEN), "b": np.array([-1.0], np.float32)}
    for d in "fb":
        m["x" + d], m["u" + d], m["c" + d] = small(WORD_DIM + GRAM_DIM, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        m["c" + d][:HIDDEN] = 0.5
    return m


def word_vectors(m: dict, x: Inputs) -> np.ndarray:
    chars = np.add.reduceat(m["grams"][x.grams], x.gram_at) / x.gram_n[:, None] if len(x.keys) else np.zeros((0, GRAM_DIM), np.float32)
    return np.concatenate([m["words"][x.one] + m["words"][x.two], chars], axis=1).astype(np.float32)


def _sig(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(m: dict, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """One direction over (T, B, 3H) gate inputs; hidden states (T, B, H)."""
    t_max, batch, _ = gates.shape
    h, out, u = np.zeros((batch, HIDDEN), np.float32), np.empty((t_max, batch, HIDDEN), np.float32), m["u" + d]
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        hu = h @ u
        zr = _sig(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = (c + z * (h - c)) * mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def forward(m: dict, tables: dict, win: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Logits of windows. tables: the gate inputs of each distinct word, a last row for padding."""
    idx = win.T
    mask = (idx >= 0).astype(np.float32)
    keep = {"f": [], "b": []} if cache is not None else {"f": None, "b": None}
    h = np.concatenate([_run(m, d, tables[d][idx], mask, keep[d]) for d in "fb"], axis=2)
    e = h @ m["v"] + (mask - 1) * 1e4
    a = np.exp(e - e.max(0))
    a = a * mask / np.maximum((a * mask).sum(0), 1e-9)
    pooled = (a[:, :, None] * h).sum(0)
    if cache is not None:
        cache.update(h=h, a=a, pooled=pooled, mask=mask, keep=keep, idx=idx)
    return pooled @ m["w"] + m["b"][0]


def gate_tables(m: dict, vectors: np.ndarray) -> dict:
    return {d: np.concatenate([vectors @ m["x" + d] + m["c" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}


def gradients(m: dict, vectors: np.ndarray, win: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss, gradients of the network's weights and of the word vectors, by back-propagation through time."""
    cache: dict = {}
    s = forward(m, gate_tables(m, vectors), win, cache)
    p = _sig(s)
    loss = float((weight * (np.logaddexp(0, s) - y * s)).sum())
    ds = (weight * (p - y)).astype(np.float32)
    h, a, pooled, mask = cache["h"], cache["a"], cache["pooled"], cache["mask"]
    g = {"w": pooled.T @ ds, "b": np.array([ds.sum()], np.float32)}
    dp = ds[:, None] * m["w"]
    da = (h * dp).sum(2)
    de = a * (da - (a * da).sum(0))
    g["v"] = (h * de[:, :, None]).sum((0, 1))
    dh_all = a[:, :, None] * dp + de[:, :, None] * m["v"]
    dvec = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float32)
    for k, d in enumerate("fb"):
        u = m["u" + d]
        g["u" + d], g["x" + d], g["c" + d] = np.zeros_like(u), np.zeros_like(m["x" + d]), np.zeros(3 * HIDDEN, np.float32)
        carry = np.zeros((win.shape[0], HIDDEN), np.float32)
        for t, hp, z, r, c, hc in reversed(cache["keep"][d]):
            dh = (dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry) * mask[t][:, None]
            dz, dc = dh * (hp - c), dh * (1 - z)
            dac = dc * (1 - c * c)
            daz, dar = dz * z * (1 - z), dac * hc * r * (1 - r)
            dhu = np.concatenate([daz, dar, dac * r], axis=1)
            carry = dh * z + dhu @ u.T
            g["u" + d] += hp.T @ dhu
            dx = np.concatenate([daz, dar, dac], axis=1)
            g["c" + d] += dx.sum(0)
            idx = cache["idx"][t]
            ok = idx >= 0
            g["x" + d] += vectors[idx[ok]].T @ dx[ok]
            np.add.at(dvec, idx, dx @ m["x" + d].T)
    return loss, g, dvec[:-1]


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> dict | None:
    if not (y == 1).any() or not (y == 0).any():
        return None
    m, rng = start(seed), np.random.default_rng(seed)
    x = Inputs(*textbuf.buffers(pa.array(texts, pa.string())))
    win, text = x.windows()
    # first embeddings: how much likelier a toxic text holds a word, from this sample
    held = np.unique(np.stack([np.repeat(np.arange(len(y)), np.diff(x.bounds)), x.word]), axis=1)
    toxic = np.bincount(held[1], y[held[0]], len(x.keys))
    clean = np.bincount(held[1], 1 - y[held[0]], len(x.keys))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    for place in (x.one, x.two):
        n = np.bincount(place, toxic + clean, WORDS)
        m["words"][:, 0] += (np.bincount(place, odds * (toxic + clean), WORDS) / np.maximum(n, 1) * np.minimum(n / 10, 1) * 0.25).astype(np.float32)
    moments: dict = {}
    step = 0
    for r in range(ROUNDS):
        if r == 0:
            v = word_vectors(m, x)[:, 0]
            best = np.where(win >= 0, v[win], -9.0).max(1)
        else:
            best = logits(m, x, win)
        top = _top(best, text, len(y))
        chosen = np.concatenate([top, rng.choice(np.flatnonzero(y[text] == 0), min(len(top), int((y[text] == 0).sum())), replace=False)])
        for _ in range(EPOCHS):
            rng.shuffle(chosen)
            for b in range(0, len(chosen), 128):
                part = chosen[b : b + 128]
                uniq, inv = np.unique(win[part], return_inverse=True)
                inv = inv.reshape(win[part].shape) - int(uniq[0] == -1)
                uniq = uniq[uniq >= 0]
                if not len(uniq):
                    continue
                vec = _vectors_of(m, x, uniq)
                _, g, dv = gradients(m, vec, inv, y[text[part]].astype(np.float32), np.full(len(part), 1 / len(part), np.float32))
                gw = np.zeros_like(m["words"])
                np.add.at(gw, x.one[uniq], dv[:, :WORD_DIM])
                np.add.at(gw, x.two[uniq], dv[:, :WORD_DIM])
                gg = np.zeros_like(m["grams"])
                size = x.gram_n[uniq]
                at = np.repeat(x.gram_at[uniq] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                np.add.at(gg, x.grams[at], np.repeat(dv[:, WORD_DIM:] / size[:, None], size, axis=0))
                g["words"], g["grams"] = gw, gg
                step += 1
                for k, gk in g.items():
                    a, b2 = moments.setdefault(k, [np.zeros_like(m[k]), np.zeros_like(m[k])])
                    a += 0.1 * (gk - a)
                    b2 += 0.01 * (gk * gk - b2)
                    m[k] -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def _vectors_of(m: dict, x: Inputs, which: np.ndarray) -> np.ndarray:
    size = x.gram_n[which]
    before = np.cumsum(size) - size
    at = np.repeat(x.gram_at[which] - before, size) + np.arange(size.sum())
    chars = np.add.reduceat(m["grams"][x.grams[at]], before) / size[:, None]
    return np.concatenate([m["words"][x.one[which]] + m["words"][x.two[which]], chars], axis=1).astype(np.float32)


def _top(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The window of each text with the highest value."""
    order = np.lexsort((values, text))
    return order[np.searchsorted(text[order], np.arange(n), "right") - 1]


def logits(m: dict, x: Inputs, win: np.ndarray) -> np.ndarray:
    tables = gate_tables(m, word_vectors(m, x))
    return np.concatenate([forward(m, tables, win[a : a + AT_ONCE]) for a in range(0, len(win), AT_ONCE)]) if len(win) else np.zeros(0)


def score(m: dict | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest window score of each text."""
    n = len(offsets) - 1
    if m is None:
        return np.zeros(n)
    out = []
    for a, b in textbuf.byte_slices(offsets, 2 << 20):
        x = Inputs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        win, text = x.windows()
        s = logits(m, x, win)
        out.append(np.maximum.reduceat(s, np.searchsorted(text, np.arange(b - a))))
    return linear.sigmoid(np.concatenate(out)) if out else np.zeros(0)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict | None:
    some, _ = labelled(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS), labels, "toxic", SAMPLE)
    rows = some.orderBy("label", F.xxhash64("text"), "text").collect()
    return train([r["text"] for r in rows], np.array([float(r["label"]) for r in rows]))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    shared = spark.sparkContext.broadcast(learn(spark, docs, labels))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch):
        s = score(shared.value, *textbuf.buffers(batch["text"]))
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())})

    return map_batches(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the texts that are predicted toxic; all columns are kept."""
    shared = spark.sparkContext.broadcast(learn(spark, docs, labels))

    def run(batch):
        return batch.filter(pa.array(score(shared.value, *textbuf.buffers(batch["text"])) < 0.5))

    return map_batches(docs, run, docs.schema)
