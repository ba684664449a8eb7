"""Secret scans by an incremental ledger of blobs.

A blob is one text by content, whatever rows and versions hold it. The ledger is a table of the (blob, rule version) pairs already
scanned, with their findings. A scan takes only pairs that are not in it, adds them, and joins the findings back to all paths.

Defined results: a null or empty text is the empty blob and has no findings; repeated rows get the findings each; an empty
table gives no rows; extra columns are left out. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, scratch_path

#: The base kinds in their order, then the kinds this scanner adds. (kind, pattern, group that is measured, least length)
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # maximal runs, as [0-9a-f]+ with shorter ones dropped
]
ADDED = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
RULES = {"base": BASE, "added": ADDED}
#: One of these is in every match of a rule (lower-cased where case is free), so that texts without any are not searched.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN",), "forge": ("gh",), "jwt": ("eyJ",)}
#: Bits of the filter of blobs that several rows or the ledger hold (16 MB), and of the pieces that tasks make of it.
FILTER_BITS, WORD = 1 << 27, 1 << 16
FINDINGS = "array<struct<kind:string,start:long,end:long>>"


def version(rules: list) -> str:
    """Names a set of rules by its content."""
    return hashlib.sha256(repr(("ascii", rules)).encode()).hexdigest()[:16]


def matches(text: str, rules: list) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by start and then in the order of the rules."""
    out, low = [], None
    for order, (kind, pattern, group, least) in enumerate(rules):
        hints = HINTS.get(kind, ())
        if hints:
            hay = text
            if kind == "assign":
                low = text.lower() if low is None else low
                hay = low
            if not any(h in hay for h in hints):
                continue
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path: (blob, rules, findings); a new one is empty."""
    schema = f"blob string, rules string, findings {FINDINGS}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan(spark: SparkSession, paths: DataFrame, ledger: str, rules: dict[str, list] | None = None, search=matches) -> DataFrame:
    """paths: (path, text), a row for each historical version of each path. (path, blob, findings per rule set) of every row.

    Only (blob, rule version) pairs that the ledger lacks are scanned, each once; the ledger grows by them. A blob of one row of which
    nothing is known is scanned where its text lies. Blobs of several rows, or of which the ledger knows a version, are marked in a bit
    filter of a fixed size; the rows it lets through, a few others included, meet by blob, and one text of each is scanned for what it lacks.
    """
    rules = rules or RULES
    versions = {version(r): r for r in rules.values()}
    known = open_ledger(spark, ledger)
    hashed = paths.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    rows = cut_lineage(hashed.select("path", "blob"), "secret-rows")
    done = known.where(F.col("rules").isin(*versions)).groupBy("blob").agg(F.collect_set("rules").alias("done"))  # a few versions a blob
    met = rows.groupBy("blob").agg(F.count("*").alias("n")).join(done, "blob", "left")
    marked = cut_lineage(met.where("n > 1 or done is not null").select("blob", F.coalesce("done", F.array().cast("array<string>")).alias("done")), "secret-marked")
    bits = _marks(marked)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(todo):
        out = [(blob, name, [{"kind": k, "start": s, "end": e} for k, s, e in search(text, versions[name])]) for blob, text, names in todo for name in names]
        blobs, names, spans = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(spans, kind)], names=["blob", "rules", "findings"])

    def inside(batch):
        at = np.array([int(b[:8], 16) % FILTER_BITS for b in batch["blob"].to_pylist()], np.int64)
        return (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def alone(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~inside(batch)))
            yield found((b, t, versions) for b, t in zip(batch["blob"].to_pylist(), batch["text"].to_pylist()))

    def through(batches):
        for batch in batches:
            yield batch.filter(pa.array(inside(batch)))

    def lacking(batches):
        for batch in batches:
            yield found(zip(*(batch[c].to_pylist() for c in ("blob", "text", "lacks"))))

    schema = f"blob string, rules string, findings {FINDINGS}"
    texts = hashed.select("blob", "text")
    here = texts.mapInArrow(alone, schema)
    lacks = marked.withColumn("lacks", F.array_except(F.array(*map(F.lit, versions)), "done")).select("blob", "lacks")
    # others that the filter lets through have a blob of their own and lack every version
    meet = texts.mapInArrow(through, "blob string, text string").join(lacks, "blob", "left")
    meet = meet.withColumn("lacks", F.coalesce("lacks", F.array(*map(F.lit, versions)))).where(F.size("lacks") > 0)
    one = meet.groupBy("blob").agg(F.first("text").alias("text"), F.first("lacks").alias("lacks"))
    here.unionByName(one.select("blob", "text", "lacks").mapInArrow(lacking, schema)).write.mode("append").parquet(ledger)
    now = spark.read.schema(known.schema).parquet(ledger)
    out = rows
    for name, r in rules.items():
        hits = now.where((F.col("rules") == version(r)) & (F.size("findings") > 0)).select(F.col("blob").alias("b"), F.col("findings").alias(name))
        out = out.join(hits, out["blob"] == hits["b"], "left").drop("b")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(FINDINGS)))
    return out


def _marks(blobs: DataFrame):
    """A broadcast bit filter of blobs, FILTER_BITS in all, whatever their number."""
    at = F.conv(F.substring("blob", 1, 8), 16, 10).cast("long") % FILTER_BITS
    words = blobs.select(at.alias("at")).groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.collect_set((F.col("at") % WORD).cast("int")).alias("set"))

    def packed(batches):
        for batch in batches:
            out = []
            for places in batch["set"]:
                b = np.zeros(WORD, np.uint8)
                b[places.values.to_numpy()] = 1
                out.append(zlib.compress(np.packbits(b, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(out, pa.binary())], names=["word", "bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in words.mapInArrow(packed, "word long, bits binary").toLocalIterator():
        bits[row.word * WORD // 8 : (row.word + 1) * WORD // 8] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return blobs.sparkSession.sparkContext.broadcast(bits)


def as_text(findings):
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))


def report(spark: SparkSession, docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text).

    The table arrives twice, half of it first and then whole: what the first arrival scanned the second one finds in the ledger.
    """
    ledger = ledger or scratch_path(spark, "secret-ledger")
    paths = docs.select(F.col("doc_id").alias("path"), "text")
    scan(spark, paths.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0), ledger)
    found = scan(spark, paths, ledger)
    order = F.array(*[F.lit(k[0]) for k in BASE + ADDED])
    merged = F.sort_array(F.transform(F.concat("base", "added"), lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["kind"]).alias("o"), f["kind"].alias("kind"), f["end"].alias("end"))))
    count = lambda k: F.size(F.filter("base", lambda f: f["kind"] == k)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(merged).alias("spans"),
    )
