"""Length-delimited binary records of token ids, with an offset index.

Every record is framed as a little-endian length of 8 bytes, the masked checksum of these bytes, the payload and the payload's
masked checksum. A payload is a doc id, the width of an id in bytes and the ids. Beside each file lies an index of doc ids, record offsets and
counts, so records can be read in any order. Files hold documents in ascending doc_id order, over all files; a file that grows
past a bound is followed by another.

The list of files is itself a table that Spark commits: files of lost or repeated task attempts are not in it.

Defined results: a null or empty text is the end id alone; null doc_ids come first; repeated rows are records each; an empty
table has no files; extra columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encode, textbuf
from .common import cut_lineage, scratch_path

END_ID = 2
FILE_BYTES = 64 << 20
_NULL_ID = -(1 << 63)
_MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    """A checksum rotated and shifted, so that the checksum of data that holds checksums is still good."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))])


def unframe(stream) -> bytes | None:
    """The next payload of a stream; None at its end; an error for a broken record."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("broken record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("broken record")
    return body[:size]


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<qB", _NULL_ID if doc_id is None else doc_id, ids.dtype.itemsize) + ids.tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack("<qB", payload[:9])
    return None if doc_id == _NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9)


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)


def write(docs: DataFrame, folder: str, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs (doc_id, text) to record files below folder; (file, task, seq, records, ids) of the files written."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        enc, out, seq, done = encode.encoder(path), None, 0, []

        def close():
            data, index, name, at = out
            data.close()
            with store.open_output_stream(f"{base}/{name}.index") as x:
                x.write(b"".join(index))
            done[-1][3] = len(index)

        for batch in batches:
            data, offsets = textbuf.buffers(batch["text"])
            docs_ids = batch["doc_id"].to_pylist()
            for a, b in textbuf.byte_slices(offsets, 8 << 20):
                ids, bounds = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(b - a):
                    if out is None:
                        name = f"part-{task:06d}-{seq:04d}-{attempt}"
                        out = [store.open_output_stream(f"{base}/{name}.records"), [], name, 0]
                        done.append([f"{folder.rstrip('/')}/{name}", task, seq, 0, 0])
                    doc = np.append(ids[bounds[i] : bounds[i + 1]], ids.dtype.type(END_ID))
                    raw = frame(record(docs_ids[a + i], doc.astype(doc.dtype.newbyteorder("<"))))
                    out[0].write(raw)
                    out[1].append(struct.pack("<qQQ", _NULL_ID if docs_ids[a + i] is None else docs_ids[a + i], out[3], len(doc)))
                    out[3] += len(raw)
                    done[-1][4] += len(doc)
                    if out[3] >= file_bytes:
                        close()
                        out, seq = None, seq + 1
        if out is not None:
            close()
        if done:
            cols = list(zip(*done))
            yield pa.RecordBatch.from_pydict({
                "file": pa.array(cols[0], pa.string()), "task": pa.array(cols[1], pa.int64()), "seq": pa.array(cols[2], pa.int64()),
                "records": pa.array(cols[3], pa.int64()), "ids": pa.array(cols[4], pa.int64()),
            })

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return cut_lineage(ordered.mapInArrow(run, "file string, task long, seq long, records long, ids long"), "record-files")


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files, read from their bytes."""
    spark = files.sparkSession
    first = F.coalesce(F.sum("ids").over(W.orderBy("task", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    based = files.withColumn("base", first)
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        for batch in batches:
            for url, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                store, name = _open(url)
                rows = []
                with store.open_input_stream(name + ".records", buffer_size=1 << 20) as stream:
                    while (payload := unframe(stream)) is not None:
                        doc_id, ids = parse(payload)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4"))))
                        base += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return based.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_some(file: str, wanted: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of given positions of one file, in the order asked for, by its index: a shuffled read."""
    store, name = _open(file)
    with store.open_input_stream(name + ".index") as x:
        index = list(struct.iter_unpack("<qQQ", x.read()))
    out = []
    with store.open_input_file(name + ".records") as stream:
        for i in wanted:
            stream.seek(index[i][1])
            out.append(parse(unframe(stream)))
    return out


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(write(docs, scratch_path(spark, "token-records"), path or encode.vocabulary()))
