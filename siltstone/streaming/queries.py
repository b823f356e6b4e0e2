"""Windowed queries over ``events``; the definitions are those that streams use."""

from __future__ import annotations

import pyspark.sql.functions as F

from siltstone.operators.base import Family
from siltstone.sources.session import shared_folder

from .statements import last_written, read_stream, sessions, windowed_counts, write_last

family = Family()
query = family.query


@query("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return windowed_counts(t("events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_run", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_run(t):
    """The same windows by a stream that reads all events, keeps its state, and ends."""
    out = shared_folder(t.spark, "stream-run")
    run = write_last(windowed_counts(read_stream(t("events"), t.spark, t.folder, "events")), f"{out}/counts", f"{out}/checkpoint")
    run.awaitTermination()
    return last_written(t.spark, f"{out}/counts").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_sliding", "SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def stream_sliding(t):
    return windowed_counts(t("events"), size="2 hours", slide="1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "stream_sessions",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, cut DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k",
)
def stream_sessions(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return sessions(t("events")).withColumns({"session_start": text("session_start"), "session_end": text("session_end")})
