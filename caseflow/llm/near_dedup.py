"""Near duplicates by min-max hashing.

Every document's set of word shingles gets a signature that holds the minimum and the maximum of each permutation, so half as
many hash evaluations give the same number of values. Bands of eight values are the candidate keys: with 80 bands a pair at
similarity 0.8 is missed with probability (1 - 0.8^8)^80 < 5e-7, and one at 0.3 met with 0.006. Documents with equal sets are one class; only classes are banded.

Candidates are confirmed on full sets, but never as all pairs of a crowded bucket. In rounds, each class outside the largest
component of a bucket is compared with a few members of that component, those first that share most bands with others: an original
agrees with its copies more than edited copies agree with each other, so it is met before them. Confirmed links join components, and
buckets of one component are done. Classes that are left in buckets of several components meet once more, by the shingles of which two
sets at similarity 0.8 must share one: with all shingles in one order, rarest first, the first ones of each set, as many as the sizes of
both allow to differ. Shared passages and what a group of copies has in common come late in that order. So every candidate pair ends up
compared, within one component, or proved to be under 0.8.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing; equal sets always link; repeated
rows are rows of one class; a null doc_id is never smallest unless all are null, and is kept only then. One row of each component
is kept: one of the smallest id, among several of that id by the digest of the set. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf
from .common import components, cut_lineage, drop, kept, map_batches, release

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 80, 8
#: Bytes of text worked on at once.
SLICE = 4 << 20
#: Bits that mark the documents whose sets are wanted (4 MB); others that share a bit cost time and change nothing.
WANTED_BITS = 1 << 25
#: Rows of first shingles that a task holds before it passes them on.
HEADS = 1 << 17
#: Rounds of hubs at most; none more once the pairs left in buckets are fewer than this many times the classes.
HUB_ROUNDS, PAIRS_PER_CLASS = 2, 1
#: Slots in which shingles are counted to put them in an order (32 MB at most), and slots that are sent together.
SLOTS, SLOTS_SENT = 1 << 24, 1 << 14
#: Sets of one size class differ in size by less than this factor.
SIZE_STEP = 1.05
#: Members of a bucket's largest component that a class outside it is compared with in one round (one in the first).
HUBS = 4


def _constants(n: int, seed: int) -> np.ndarray:
    return textbuf.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed)) | np.uint64(1)


def signatures(values: np.ndarray, bounds: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each permutation for each non-empty set: two arrays (sets, permutations)."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    low, high = np.empty((len(full), permutations), np.uint32), np.empty((len(full), permutations), np.uint32)
    starts, half = bounds[:-1][full], values.astype(np.uint32)
    for p, (a, b) in enumerate(zip(_constants(permutations, 17).astype(np.uint32), _constants(permutations, 71).astype(np.uint32))):
        v = half ^ b
        v *= a
        v ^= v >> np.uint32(15)
        v *= a
        low[:, p] = np.minimum.reduceat(v, starts)
        high[:, p] = np.maximum.reduceat(v, starts)
    return low, high


def bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(non-empty sets, BANDS) keys; half of the bands are made of minima, half of maxima."""
    low, high = signatures(values, bounds, BANDS * ROWS // 2)
    sig = np.concatenate([low, high], axis=1).reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(_constants(BANDS, 5), sig.shape[:2]).copy()
    for r in range(ROWS):
        key = textbuf.mix(key * np.uint64(0x8CB92BA72F3D8DD7) + sig[:, :, r].astype(np.uint64))
    return key


def _sets(texts: pa.Array):
    """Distinct shingles of each text, slice by slice: (values, bounds)."""
    data, offsets = textbuf.buffers(texts)
    for a, b in textbuf.byte_slices(offsets, SLICE):
        base = offsets[a]
        hashes, bounds, _, _ = textbuf.words(data[base : offsets[b]], offsets[a : b + 1] - base, ~textbuf.SPACE)
        yield textbuf.distinct(*textbuf.shingles(hashes, bounds, SHINGLE))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _digest(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and 128 bits that name it."""
    full, n = np.flatnonzero(np.diff(bounds) > 0), len(bounds) - 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(full):
        a[full] = np.add.reduceat(values, bounds[:-1][full])
        b[full] = np.add.reduceat(textbuf.mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
    return np.diff(bounds), a, b


def _summaries(batch):
    """doc_id, size of the set, 128 bits that name the set, band keys."""
    sizes, one, two, keys = [], [], [], []
    for values, bounds in _sets(batch["text"]):
        full = np.flatnonzero(np.diff(bounds) > 0)
        n, a, b = _digest(values, bounds)
        k = [None] * len(n)
        if len(full):
            for i, row in zip(full, bands(values, bounds).view(np.int64)):
                k[i] = row
        sizes.append(n)
        one.append(a)
        two.append(b)
        keys += k
    return pa.RecordBatch.from_pydict({
        "doc_id": batch["doc_id"], "n_shingles": pa.array(np.concatenate(sizes), pa.int64()), "s1": _signed(np.concatenate(one)), "s2": _signed(np.concatenate(two)),
        "bands": pa.array(keys, pa.list_(pa.int64())),
    })


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with n_shingles, s1 and s2, which name the set of a text."""
    sizes, one, two = zip(*(_digest(values, bounds) for values, bounds in _sets(batch["text"])))
    cols = [pa.array(np.concatenate(sizes), pa.int64()), _signed(np.concatenate(one)), _signed(np.concatenate(two))]
    return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n_shingles", "s1", "s2"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    return decide(docs).select("doc_id", "n_shingles", "component_id", "kept")


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, component_id, kept) for every row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    summed = map_batches(docs.select("doc_id", "text"), _summaries, f"doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>")
    banded = kept(summed.withColumn("uid", F.monotonically_increasing_id()), "near-banded")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "n_shingles", "s1", "s2", "uid")).alias("first")
    whole = kept(
        banded.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(first, F.min("bands").alias("bands")).withColumn("first_id", F.col("first.doc_id")).withColumn("node", F.monotonically_increasing_id()),
        "near-whole",
    )
    # bands take most of the space and are needed for candidate keys only
    rows, classes = cut_lineage(banded.drop("bands"), "near-rows"), cut_lineage(whole.drop("bands", "first_id"), "near-classes")
    drop(banded)
    release(docs.sparkSession)
    filled = rows.where("n_shingles > 0")
    found = _components(docs, whole)
    # the first row of each component, by its smallest id, over its classes
    of = classes.select("node", "n_shingles", "s1", "s2", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    named = of.join(least, "root").select("n_shingles", "s1", "s2", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("first_uid"))
    linked = filled.join(named, ["n_shingles", "s1", "s2"])
    linked = linked.select("doc_id", "n_shingles", "s1", "s2", "component_id", (F.col("uid") == F.col("first_uid")).alias("kept"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "s1", "s2", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def _keys(whole: DataFrame) -> DataFrame:
    """(node, n_shingles, key, met) of the keys that several classes hold; met: how many (class, band) pairs a class meets there."""
    keys = whole.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")).select("node", "n_shingles", F.xxhash64("band", "key").alias("key"))
    crowded = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "near-crowded")
    release(whole.sparkSession)
    shared = kept(keys.join(crowded.hint("merge"), "key"), "near-shared")  # by one plan at all sizes
    met = shared.groupBy("node").agg(F.sum("c").alias("met"))
    out = kept(shared.join(met, "node").select("node", "n_shingles", "key", "met"), "near-keys")
    drop(shared)
    release(whole.sparkSession)
    return out


def _components(docs: DataFrame, whole: DataFrame, compared: list[int] | None = None) -> DataFrame:
    """(node, root) of the classes that are linked with others; `whole`, with bands, is deleted. `compared` gets the number of pairs of each round."""
    keys = table = _keys(whole)
    classes = cut_lineage(whole.select("node", "n_shingles", "s1", "s2", "first_id"), "near-slim")
    drop(whole)
    if keys.isEmpty():
        return classes.select("node", F.col("node").alias("root")).limit(0)
    sets = _sets_of(docs, classes.join(keys.select("node").distinct(), "node", "left_semi"))
    few = PAIRS_PER_CLASS * classes.count()
    links: list[DataFrame] = []
    tried: list[DataFrame] = []
    label = None
    for r in range(1000):
        root = F.col("node") if label is None else F.coalesce("root", "node")
        cur = kept((keys if label is None else keys.join(label, "node", "left")).select("node", "n_shingles", "key", "met", root.alias("root")), "near-open")
        drop(table)  # what it read is superseded
        # the components of each bucket, its largest one, and the member of that for this round: of most meetings, ever more coarsely
        by = F.struct((-F.shiftright("met", min(r, 62))).alias("met"), F.xxhash64("node", F.lit(r), *([] if r == 0 else ["key"])).alias("h"), F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"))
        part = cur.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(by).alias("pick"))
        major = F.max(F.struct("c", (-F.col("pick.met")).alias("met"), F.xxhash64("root", F.lit(r)).alias("h"), "root", "pick")).alias("major")
        bucket = part.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), major).where("k > 1")
        bucket = kept(bucket.select("key", "n", "sq", F.col("major.root").alias("major"), "major.pick.hub", "major.pick.hub_n"), "near-buckets")
        left = int(bucket.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2)).first()[0] or 0)
        if not left:
            drop(cur, bucket)
            table = None
            break
        table = kept(cur.join(bucket.select("key", "major", "hub", "hub_n"), "key"), "near-mixed")
        drop(cur, bucket)
        keys = table.select("node", "n_shingles", "key", "met")  # a bucket of one component stays one
        outside = table.where("root <> major")
        last = left <= few or r >= HUB_ROUNDS
        if last:
            new = _prefix_pairs(sets.join(table.select("node", "root").distinct(), "node"))
        else:
            near_hub = outside.where(_size_bound("n_shingles", "hub_n")).select("node", "hub").distinct()
            nth = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("hub", F.lit(r)), "hub"))  # a node is in BANDS buckets at most
            chosen = near_hub.withColumn("nth", nth).where(F.col("nth") <= (1 if r == 0 else HUBS))
            new = chosen.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        for t in tried:
            new = new.join(t, ["a", "b"], "left_anti")
        tried.append(kept(new, "near-pairs"))
        if compared is not None:
            compared.append(tried[-1].count())
        links.append(_confirmed(tried[-1], sets))
        release(docs.sparkSession)
        label = components(reduce(DataFrame.union, links), "near-components")
        if last:
            break
    else:
        raise RuntimeError("hub rounds did not end")
    drop(*tried, table)
    return label if label is not None else classes.select("node", F.col("node").alias("root")).limit(0)


def _need(n, m):
    """Members that sets of n and m have in common at least if they link."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles fall into each slot, over all sets; SLOTS numbers, added up by tasks."""
    def count(batches):
        for batch in batches:
            all_ = np.asarray(batch["set"].flatten()).view(np.uint64)
            slots, n = np.unique((all_ & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
            part = slots // SLOTS_SENT
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(slots) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(slots))
            body = [((slots[a:b] % SLOTS_SENT).astype(np.uint16).tobytes(), n[a:b].astype(np.uint32).tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array([x for x, _ in body], pa.binary()), pa.array([x for _, x in body], pa.binary())], names=["part", "slots", "n"])

    def add(batches):
        cur, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([cur], pa.int32()), pa.array([zlib.compress(np.minimum(total, 65_535).astype(np.uint16).tobytes(), 1)], pa.binary())], names=["part", "n"])

        for batch in batches:
            for part, slots, n in zip(*(batch[c].to_pylist() for c in ("part", "slots", "n"))):
                if part != cur:
                    if cur is not None:
                        yield done()
                    cur, total = part, np.zeros(SLOTS_SENT, np.int64)
                total[np.frombuffer(slots, np.uint16)] += np.frombuffer(n, np.uint32)
        if cur is not None:
            yield done()

    counted = sets.select("set").mapInArrow(count, "part int, slots binary, n binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, n binary")
    out = np.zeros(SLOTS, np.uint16)
    for row in counted.toLocalIterator():
        out[row.part * SLOTS_SENT : (row.part + 1) * SLOTS_SENT] = np.frombuffer(zlib.decompress(bytes(row.n)), np.uint16)
    return out


def _prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (node, root, set) of different roots among which are all that link.

    Two sets of n and m members that link have need(n, m) of them in common, so the first common one, in any one order of all members,
    is among the first n - need(n, m) + 1 of the one and m - need(n, m) + 1 of the other. A set gives its first ones for each
    size class that its partner may be of; at the place where two sets meet, enough members must be left in both.
    """
    sets = kept(sets.select("node", "root", "set"), "near-left")
    shared = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))
    step = np.log(SIZE_STEP)

    def heads(batches):
        cols, held = [[] for _ in range(5)], 0

        def done():
            flat = [pa.array(np.concatenate(c), pa.int64()) for c in cols]
            return pa.RecordBatch.from_arrays(flat, names=["node", "root", "key", "n", "rest"])

        for batch in batches:
            for node, root, members in zip(batch["node"].to_pylist(), batch["root"].to_pylist(), batch["set"]):
                v = np.asarray(members.values).view(np.uint64)
                n = len(v)
                rare = shared.value[(v & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((v, rare))
                v, met = v[order], rare[order] > 1  # a shingle alone in its slot is in no other set
                own, least, most = int(np.log(n) / step), -(-PERCENT * n // 100), 100 * n // PERCENT
                for other in range(int(np.log(least) / step), int(np.log(most) / step) + 1):
                    low = max(least, int(np.exp(other * step)))  # not above the smallest size of the class
                    k = n - _need(n, low) + 1
                    if k < 1:
                        continue
                    a, b = sorted((own, other))
                    at = np.flatnonzero(met[:k])
                    key = textbuf.mix(v[at] + np.uint64((a * 4096 + b) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                    for c, x in zip(cols, (np.full(len(at), node), np.full(len(at), root), key, np.full(len(at), n), n - at)):
                        c.append(x)
                    held += len(at)
                    if held >= HEADS:
                        yield done()
                        cols, held = [[] for _ in range(5)], 0
        if held:
            yield done()

    rows = kept(sets.mapInArrow(heads, "node long, root long, key long, n long, rest long"), "near-heads")
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = by_root.groupBy("key").agg(F.count("*").alias("k"), F.max_by("root", F.struct("c", "root")).alias("major")).where("k > 1").select("key", "major")
    met = kept(rows.join(several, "key"), "near-met")
    drop(sets, rows)
    release(met.sparkSession)
    x = met.where("root <> major").select("key", F.col("node").alias("x"), F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("rest").alias("xs"))
    y = met.select("key", F.col("node").alias("y"), F.col("root").alias("yr"), F.col("n").alias("yn"), F.col("rest").alias("ys"))
    enough = F.least("xs", "ys") * (100 + PERCENT) >= PERCENT * (F.col("xn") + F.col("yn"))
    pairs = x.join(y, "key").where((F.col("xr") != F.col("yr")) & _size_bound("xn", "yn") & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _size_bound(a: str, b: str):
    """Sets of which the smaller is under 80 % of the larger cannot link."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _marked(ids: DataFrame) -> np.ndarray:
    """A filter of WANTED_BITS: the bits of the given hashes (id) are set."""
    place = F.pmod("id", F.lit(WANTED_BITS)) + 1
    found = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(WANTED_BITS // 8, np.uint8)
    for row in found.toLocalIterator():  # a bucket is 4 KB
        out[(row.b - 1) << 12 : row.b << 12] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, set) of the given classes. Sets are made where the texts lie, of documents whose id may be a wanted one; the class's own are
    the ones of its size and digest, whatever the id."""
    want = cut_lineage(classes.select("node", "n_shingles", "s1", "s2", F.xxhash64("first_id").alias("id")), "near-wanted")
    marked = docs.sparkSession.sparkContext.broadcast(_marked(want))

    def pick(batch):
        at = np.asarray(batch["id"]) % WANTED_BITS
        batch = batch.filter(pa.array((marked.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
        if not batch.num_rows:
            return None
        n, one, two, sets = [], [], [], []
        for values, bounds in _sets(batch["text"]):
            for out, x in zip((n, one, two), _digest(values, bounds)):
                out.append(x)
            sets.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _signed(values)))
        cols = [pa.array(np.concatenate(n), pa.int64()), _signed(np.concatenate(one)), _signed(np.concatenate(two)), pa.concat_arrays(sets)]
        return pa.RecordBatch.from_arrays(cols, names=["n_shingles", "s1", "s2", "set"])

    key = ["n_shingles", "s1", "s2"]
    found = map_batches(docs.select("text", F.xxhash64("doc_id").alias("id")), pick, "n_shingles long, s1 long, s2 long, set array<long>")
    out = cut_lineage(found.dropDuplicates(key).join(want.select("node", *key), key).select("node", "set"), "near-sets")
    release(docs.sparkSession)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= 80 * |union|."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return cut_lineage(x.where(common * 100 >= union * PERCENT).select("a", "b"), "near-links")
