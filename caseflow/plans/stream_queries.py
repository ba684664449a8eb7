"""Streaming queries; each ends as a table that can be compared with its batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digest import debounce
from ..session import scratch_path
from ..streaming import stream as S
from .bindings import table
from .registry import query


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream, event time as a proper timestamp."""
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def changes(e: DataFrame) -> DataFrame:
    """Each event tells whether a step (its type) of a case (its user) is done."""
    return e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("step"), (F.col("value") > 30).alias("flag"), "ts", F.col("event_id").alias("seq"))


_ANNOUNCED = """
SELECT user_id AS case_id, event_type AS step, event_id AS seq FROM (
  SELECT *, lag(value > 30) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events) WHERE was = false AND value > 30"""


@query("announcements_stream", "T1", _ANNOUNCED)
def announcements_stream(spark, sf):
    return S.run_to_table(S.announce(changes(event_stream(spark, sf))), "announced").select("case_id", "step", "seq")


@query("announcements_batch", "T1", _ANNOUNCED)
def announcements_batch(spark, sf):
    return S.announce_batch(changes(events(spark, sf)), F.to_date("ts")).select("case_id", "step", "seq")


_BURSTS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS party, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS changes FROM s GROUP BY user_id, k"""


@query("debounced_bursts", "T2", _BURSTS)
def debounced_bursts(spark, sf):
    return debounce(events(spark, sf).select(F.col("user_id").alias("party"), "ts"), "30 minutes")


@query("debounced_bursts_stream", "T2", f"""SELECT * FROM ({_BURSTS}) WHERE ended <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def debounced_bursts_stream(spark, sf):
    return S.run_to_table(S.digest_sessions(event_stream(spark, sf).select(F.col("user_id").alias("party"), "ts"), "30 minutes"), "bursts")


@query("daily_counts_stream", "T7", """
SELECT date_trunc('day', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def daily_counts_stream(spark, sf):
    return S.run_to_table(S.window_counts(event_stream(spark, sf)), "daily")


@query("deduped_intake_stream", "T5", "SELECT DISTINCT user_id || '|' || event_type || '|' || date_trunc('day', ts)::DATE AS file_key FROM events")
def deduped_intake_stream(spark, sf):
    keyed = event_stream(spark, sf).select(F.concat_ws("|", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("file_key"), "ts")
    return S.run_to_table(S.dedupe_intake(keyed, "2 days"), "intake").select("file_key")


@query("watched_folder", "S2", why_no_sql="streams file metadata")
def watched_folder(spark, sf):
    out = S.run_to_table(S.watch_folder(spark, sf, "*.parquet"), "watched")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"))


@query("sent_or_held_stream", "T3", """
SELECT user_id AS party, date_trunc('hour', ts) AS round, count(DISTINCT user_id) OVER (PARTITION BY date_trunc('hour', ts)) > 12 AS held FROM events""".replace(
    "count(DISTINCT user_id) OVER (PARTITION BY date_trunc('hour', ts)) > 12 AS held FROM events", "n > 12 AS held FROM events JOIN (SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS n FROM events GROUP BY 1) ON h = date_trunc('hour', ts)"))
def sent_or_held_stream(spark, sf):
    waiting, sent, held = (scratch_path(spark, x) for x in ("open", "sent", "held"))
    rounds = event_stream(spark, sf).select(F.col("user_id").alias("party"), F.date_trunc("hour", "ts").alias("round"))
    q = S.send_or_hold(rounds, waiting, sent, held, 12).option("checkpointLocation", scratch_path(spark, "hold-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    S.close_rounds(spark, "party bigint, round timestamp", waiting, sent, held, 12)
    read = lambda p, v: spark.read.schema("party bigint, round timestamp").parquet(p).select("party", "round").withColumn("held", F.lit(v))
    return read(sent, False).unionByName(read(held, True))


@query("rebaselined_steps", "T4", """
SELECT e.user_id AS case_id, e.event_type AS step, e.flag, 20 AS version, coalesce(p.flag = false AND e.flag AND e.event_type NOT IN ('view', 'signup'), false) AS announce
FROM (SELECT user_id, event_type, max_by(value > 30, (ts, event_id)) AS flag FROM events WHERE event_type <> 'error' GROUP BY ALL) e
LEFT JOIN (SELECT user_id, event_type, max_by(value > 30, (ts, event_id)) AS flag FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'signup' GROUP BY ALL) p
  ON p.user_id = e.user_id AND p.event_type = e.event_type""")
def rebaselined_steps(spark, sf):
    def latest(e):
        return changes(e).groupBy("case_id", "step").agg(F.max_by("flag", F.struct("ts", "seq")).alias("flag"))

    e = events(spark, sf)
    seen = latest(e.where("ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'signup'")).withColumn("version", F.expr("if(step = 'view', 19, 20)"))
    current = S.hold_while_reading(latest(e).withColumn("rejected", F.col("step") == "error").withColumn("pending", F.lit(False)))
    return S.rebaseline(seen, current, 20)

