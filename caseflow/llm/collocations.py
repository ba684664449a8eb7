"""Collocation mining with mergeable Misra-Gries summaries.

N-grams fall into hash partitions by the top bits of a 64-bit hash. Every slice of texts is counted and its counts are sent to their
partitions, where summaries merge: counters are added, and where more than the capacity are left, the first count beyond it is taken
off all of them. The capacity exceeds the partition's mass divided by the threshold (mass rows arrive before the counters), so less
than the threshold is taken off in sum, and every n-gram that reaches it survives. A partition passes its survivors on as its piece of
one bit filter of a fixed size; bits that others set too, or that were only nearly reached, cost time and change nothing. The last
pass counts what the filters let through exactly, by the phrases themselves.

Three words only matter where both pairs in them do, so pairs are summed up first and threes after that.

Defined results: a null text has no words, a null lang is `und`; repeated rows count each time; only A-Z are lower-cased; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf
from .common import cut_lineage

LEAST, TOP, COVER = 10, 2000, 50
#: Bytes of text counted at once, some forty bytes of a worker's memory for each. A longer text is taken whole.
SLICE = 2 << 20
#: Bytes of text for each hash partition, and the number of partitions at least and at most (powers of two).
SHARE, FEWEST, MOST = 16 << 20, 64, 1 << 16
#: Bits of the filter of each length of phrases, over all partitions: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: Counters that wait to be merged.
WAITING = 1 << 18
#: Parts of a language that are ranked before the whole.
RANK_PARTS = 64

#: What ends a piece, and what separates words within one.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = np.isin(np.arange(256), list(ENDS))
INSIDE = ~np.isin(np.arange(256), list(ENDS + GAPS))


class _Slice:
    """Words of some texts as places in a vocabulary, and which of them stand next to each other within a piece."""

    def __init__(self, lang: str, data: np.ndarray, offsets: np.ndarray):
        data = textbuf.LOWER[data]
        hashes, bounds, starts, ends = textbuf.words(data, offsets, INSIDE, lower=False)
        self.n = len(starts)
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        packed = pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(at), pa.py_buffer(data[INSIDE[data]])])
        coded = packed.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.v = max(len(self.vocabulary), 1)
        seed = np.uint64(zlib.crc32(lang.encode()) + 1)
        self.hash = np.zeros(self.v, np.uint64)
        self.hash[self.ids] = textbuf.mix(hashes ^ textbuf.mix(seed * np.uint64(0x9E3779B97F4A7C15)))
        stops = np.cumsum(END[data], dtype=np.int32)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.pair = (stops[starts[1:]] == stops[ends[:-1] - 1]) & (text[1:] == text[:-1]) if self.n else np.zeros(0, bool)

    def words(self):
        return np.bincount(self.ids, minlength=len(self.vocabulary))

    def pairs(self):
        """(left ids, right ids, counts, place of each adjacent pair among them, -1 elsewhere)."""
        codes, which, counts = np.unique((self.ids[:-1] * self.v + self.ids[1:])[self.pair], return_inverse=True, return_counts=True)
        place = np.full(len(self.pair), -1, np.int64)
        place[self.pair] = which
        return codes // self.v, codes % self.v, counts, place

    def threes(self, good: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray):
        """(ids of the three words, counts) where both pairs are good."""
        ok = np.concatenate([good, [False]])[place]
        both = np.flatnonzero(ok[:-1] & ok[1:])
        codes, counts = np.unique(place[both] * self.v + self.ids[both + 2], return_counts=True)
        pair = codes // self.v
        return left[pair], right[pair], codes % self.v, counts

    def keys(self, *ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids[0]), len(ids), np.uint64)
        for i in ids:
            out = textbuf.mix(out * np.uint64(0x8CB92BA72F3D8DD7) + self.hash[i])
        return out

    def phrases(self, *ids: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(self.vocabulary.take(pa.array(i)) for i in ids), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _slices(batch: pa.RecordBatch):
    langs = batch["lang"]
    for lang in langs.unique().to_pylist():
        data, offsets = textbuf.buffers(batch["text"].filter(pc.equal(langs, lang)))
        for a, b in textbuf.byte_slices(offsets, SLICE):
            base = offsets[a]
            yield lang, _Slice(lang, data[base : offsets[b]], offsets[a : b + 1] - base)


class _Filter:
    """Which hashes may be of frequent n-grams: a bit per (partition, low bits of the hash)."""

    def __init__(self, bits: np.ndarray, partitions: int):
        self.bits, self.partitions = bits, partitions

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _places(keys, self.partitions, len(self.bits) * 8 // self.partitions)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _partition(keys: np.ndarray, partitions: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (partitions.bit_length() - 1))).astype(np.int64) if partitions > 1 else np.zeros(len(keys), np.int64)


def _places(keys: np.ndarray, partitions: int, each: int) -> np.ndarray:
    return _partition(keys, partitions) * each + (keys & np.uint64(each - 1)).astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counters added up by key, then brought down to the capacity: (keys, counts, what was taken off each)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys, counts = keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return keys[left], counts[left] - off, off


class Summary:
    """A Misra-Gries summary of known capacity; add() merges another one's counters."""

    def __init__(self, capacity: int):
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(WAITING, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        self.keys, self.counts, off = merge(keys, np.concatenate([self.counts, *(c for _, c in self.waiting)]), self.capacity)
        self.off += off
        self.waiting, self.size = [], 0

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have reached `least`: all that did, if the capacity exceeds mass / least."""
        self.settle()
        return self.keys[self.counts + self.off >= least]


def _sent(keys: np.ndarray, counts: np.ndarray, partitions: int) -> pa.RecordBatch | None:
    """A slice's counters for each hash partition, and before them its mass."""
    if not len(keys):
        return None
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    part = _partition(keys, partitions)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends, mass = np.append(starts[1:], len(keys)), np.add.reduceat(counts, starts)
    rows = [(int(p), 0, int(m), None, None) for p, m in zip(part[starts], mass)]
    for p, a, b in zip(part[starts], starts, ends):
        c = counts[a:b]
        few = c.astype(np.uint8) if c.max() < 256 else c
        rows.append((int(p), 1, int(few.dtype.itemsize), keys[a:b].tobytes(), few.tobytes()))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "what", "mass", "keys", "counts"])


def _summed(batches, least: int, each: int):
    """The piece of the bit filter of each hash partition; rows come by (part, what)."""
    part, mass, summary = None, 0, None

    def piece():
        bits = np.zeros(each, np.uint8)
        bits[(summary.survivors(least) & np.uint64(each - 1)).astype(np.int64)] = 1
        body = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary())], names=["part", "bits"])

    for batch in batches:
        for p, what, m, keys, counts in zip(*(batch[c] for c in ("part", "what", "mass", "keys", "counts"))):
            p, what, m = p.as_py(), what.as_py(), m.as_py()
            if p != part:
                if summary is not None:
                    yield piece()
                part, mass, summary = p, 0, None
            if what == 0:
                mass += m
                continue
            if summary is None:
                summary = Summary(mass // least + 1)
            summary.add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint8 if m == 1 else np.int64).astype(np.int64))
    if summary is not None:
        yield piece()


def _filter(spark: SparkSession, texts: DataFrame, counted, partitions: int, least: int):
    """Sum up what `counted` gives of each slice (hashes, counts) and broadcast the filter of the survivors."""
    each = max(FILTER_BITS // partitions, 8)

    def send(batches):
        for batch in batches:
            for _, part in _slices(batch):
                out = _sent(*counted(part), partitions)
                if out is not None:
                    yield out

    def receive(batches):
        return _summed(batches, least, each)

    sent = texts.mapInArrow(send, "part int, what int, mass long, keys binary, counts binary")
    pieces = sent.repartition("part").sortWithinPartitions("part", "what").mapInArrow(receive, "part int, bits binary")
    bits = np.zeros(each * partitions // 8, np.uint8)
    for row in pieces.toLocalIterator():  # FILTER_BITS in all
        bits[row.part * each // 8 : (row.part + 1) * each // 8] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return spark.sparkContext.broadcast(bits)


def partitions_for(size: int) -> int:
    """A power of two: a hash partition for each SHARE bytes of text."""
    return min(MOST, max(FEWEST, 1 << max(0, (size // SHARE)).bit_length()))


def counts(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): exact counts of phrases of 1 to 3 words that occur `least` times at least in a language, and as words = 0
    the number of all words of each language. docs: (lang, text)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(size)

    def two(s: _Slice):
        left, right, n, _ = s.pairs()
        return s.keys(left, right), n

    pairs = _filter(spark, texts, two, parts, least)

    def three(s: _Slice):
        left, right, _, place = s.pairs()
        *ids, n = s.threes(_Filter(pairs.value, parts).has(s.keys(left, right)), left, right, place)
        return s.keys(*ids), n

    threes = _filter(spark, texts, three, parts, least)

    def exact(batches):
        for batch in batches:
            for lang, s in _slices(batch):
                left, right, n2, place = s.pairs()
                good = _Filter(pairs.value, parts).has(s.keys(left, right))
                *ids, n3 = s.threes(good, left, right, place)
                fine = _Filter(threes.value, parts).has(s.keys(*ids))
                groups = [
                    (0, pa.array([""]), np.array([s.n])), (1, s.vocabulary.cast(pa.string()), s.words()),
                    (2, s.phrases(left[good], right[good]), n2[good]), (3, s.phrases(*(i[fine] for i in ids)), n3[fine]),
                ]
                for words, phrases, n in groups:
                    k = len(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * k, pa.string()), pa.array(np.full(k, words, np.int32)), phrases, pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "f"]
                    )

    counted = texts.mapInArrow(exact, "lang string, words int, phrase string, f long")
    return cut_lineage(counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)), "phrases")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language. docs: (lang, text)."""
    found = counts(spark, docs, least)
    part = found.where("words > 0").select("lang", "phrase", "f")
    phrases = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    w = [F.col("w")[i] for i in range(3)]
    two = lambda i: F.concat_ws(" ", w[i], w[i + 1])
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1, w[0], w[1]))).otherwise(F.array(cut(1, w[0], two(1)), cut(2, two(0), w[2])))
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]
    )
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  # a product of two has 30 digits, of three 37
    cuts = cuts.withColumns({"top": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "bottom": wide("l") * wide("r")}).withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = phrases.where("words = 3").select("lang", F.explode(F.array(two(0), two(1))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= COVER * F.col("a"), F.lit(False)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    flat = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
