"""Structured Streaming forms of the continuous parts: sources, announcements, bursts, counts, intake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digest import circuit_breaker, debounce
from ..operators.scale import running_last
from ..session import cut_lineage, scratch_path


_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(spark: SparkSession, path: str, glob: str = "*.pdf", content: bool = False) -> DataFrame:
    """Continuous listing of a folder: the file source remembers what it has seen in its checkpoint."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).load(path)
    return files if content else files.drop("content")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is available now into files of the shared folder and read them back."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Neighbouring case numbers whose flags are one state: two to the power of this.
_CASES = 8


def _announce(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """False-to-true changes of one step of neighbouring cases; the first sight of a case only sets its baseline.

    The state holds a letter a case: "?" not seen, "0" or "1".
    """
    flags = pd.concat(list(batches)).sort_values(["at", "ts", "seq"])
    known = np.frombuffer((state.get[0] if state.exists else "?" * 2**_CASES).encode(), "u1").copy()
    at, flag = flags["at"].to_numpy(), flags["flag"].eq(True).to_numpy()
    first, last = np.r_[True, at[1:] != at[:-1]], np.r_[at[1:] != at[:-1], True]
    was = np.where(first, known[at], np.r_[0, 48 + flag[:-1]])
    known[at[last]] = 48 + flag[last]
    state.update((known.tobytes().decode(),))
    new = flags[(was == 48) & flag]
    case = [None if pd.isna(key[0]) else (int(key[0]) << _CASES) + int(i) for i in new["at"]]
    yield pd.DataFrame({"case_id": pd.Series(case, dtype=object), "step": key[1], "ts": new["ts"].array, "seq": new["seq"].array})


def announce(changes: DataFrame) -> DataFrame:
    """Exactly-once step announcements from a stream of (case_id, step, flag, ts, seq).

    State is one letter per case and step, kept for 256 neighbouring case numbers at a time, since every group costs a call: a busy case
    spreads over its steps and each trigger sees only new rows.
    """
    near = F.shiftright("case_id", _CASES).alias("near")
    at = F.coalesce(F.col("case_id").bitwiseAND(F.lit(2**_CASES - 1)), F.lit(0)).cast("int").alias("at")
    return changes.select(near, "step", at, "flag", "ts", "seq").groupBy("near", "step").applyInPandasWithState(
        _announce, "case_id bigint, step string, ts timestamp, seq bigint", "known string", "append", "NoTimeout"
    )


def announce_batch(changes: DataFrame, bucket: Column) -> DataFrame:
    """The same answer over a whole table, without one task per case."""
    prev = running_last(changes, ["case_id", "step"], [F.col("ts"), F.col("seq")], bucket, F.col("flag"), "was")
    return prev.where((F.col("was") == False) & F.col("flag")).select("case_id", "step", "ts", "seq")  # noqa: E712


def digest_sessions(events: DataFrame, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    return debounce(events.withWatermark("ts", late), gap)


def dedupe_intake(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each file_key once within the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_key"])


def window_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count("*").alias("n")
    ).select(F.col("w.start").alias("started"), "event_type", "n")


def send_or_hold(stream: DataFrame, open_path: str, sent_path: str, held_path: str, limit: int, delay: str = "1 hour"):
    """foreachBatch sink: a round with more parties than the limit goes to the held table, whole.

    Rows: party, round (a timestamp), ... A round may come in several batches: rows wait in the open table until a round later
    by `delay` is seen, and are counted together then; `close_rounds` routes the last ones. A row that comes after its round
    was routed is held. Every batch writes folders of its own, so a replayed one is written once.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{open_path}/batch={epoch}")
        waiting = spark.read.schema(batch.schema.simpleString()[7:-1].replace(":", " ") + ", batch long").parquet(open_path).where(F.col("batch") <= epoch)
        seen = waiting.agg(F.max("round").alias("now"), F.max(F.when(F.col("batch") < epoch, F.col("round"))).alias("before"))
        edge = seen.select((F.col("now") - F.expr(f"INTERVAL {delay}")).alias("now"), (F.col("before") - F.expr(f"INTERVAL {delay}")).alias("before")).first()
        old = F.lit(False) if edge["before"] is None else F.col("round") < F.lit(edge["before"])
        due = waiting.where((F.col("round") < F.lit(edge["now"])) & ~old) if edge["now"] is not None else waiting.limit(0)
        late = waiting.where((F.col("batch") == epoch) & old)
        _route(due.drop("batch"), late.drop("batch"), sent_path, held_path, limit, epoch)

    return stream.writeStream.foreachBatch(write)


def _route(due: DataFrame, late: DataFrame, sent_path: str, held_path: str, limit: int, epoch: int) -> None:
    verdict = circuit_breaker(due, limit).select("round", "held")
    marked = due.join(verdict, "round").unionByName(late.withColumn("held", F.lit(True)))
    marked = cut_lineage(marked, "routed")
    for held, path in ((False, sent_path), (True, held_path)):
        marked.where(F.col("held") == held).drop("held").write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def close_rounds(spark: SparkSession, schema: str, open_path: str, sent_path: str, held_path: str, limit: int, delay: str = "1 hour") -> None:
    """Route the rounds still open when the stream has ended."""
    waiting = spark.read.schema(schema + ", batch long").parquet(open_path)
    last = waiting.agg((F.max("round") - F.expr(f"INTERVAL {delay}")).alias("edge"), F.max("batch").alias("batch")).first()
    if last["batch"] is not None:
        rest = waiting.where(F.col("round") >= F.lit(last["edge"])).drop("batch")
        _route(rest, rest.limit(0), sent_path, held_path, limit, last["batch"] + 1)


def hold_while_reading(current: DataFrame) -> DataFrame:
    """The rows of a snapshot, or none while any case is still being read (pending BOOLEAN)."""
    busy = F.broadcast(current.where("pending").select(F.lit(1).alias("__one")).distinct())  # at most one row
    return current.withColumn("__one", F.lit(1)).join(busy, "__one", "left_anti").drop("__one")


def rebaseline(seen: DataFrame, current: DataFrame, version: int) -> DataFrame:
    """State to keep: a new reader version or a case coming back from rejection only resets the baseline.

    seen: case_id, step, flag, version; current: case_id, step, flag, rejected. Rejected cases leave the state.
    Returns case_id, step, flag, version, announce.
    """
    s = seen.select("case_id", "step", F.col("flag").alias("__f"), F.col("version").alias("__v"))
    j = current.where(~F.coalesce("rejected", F.lit(False))).join(s, ["case_id", "step"], "left")
    passed = (F.col("__v") == version) & (F.col("__f") == False) & F.col("flag")  # noqa: E712
    return j.select("case_id", "step", "flag", F.lit(version).alias("version"), F.coalesce(passed, F.lit(False)).alias("announce"))
