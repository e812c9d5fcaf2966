"""Streaming queries over the events, drained once, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..streaming import streams as St

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    """The last event of each user, kept by a stream of upserts."""
    events = St.stream_table(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    path = scratch_path(spark, "last-events")
    St.upsert_stream(events, path, ["user_id"], "at")
    return St.latest_version(spark, path).drop("at")


@query("WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS used FROM events GROUP BY 1, 2) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, used FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_day_counters(spark, sf_dir):
    events = St.stream_table(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    done = St.drained(St.day_counters(events, "ts", "user_id"), "day-counters")
    return done.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "used")
