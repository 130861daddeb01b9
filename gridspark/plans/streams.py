"""Queries of streams over the events table, run until all is read, beside the SQL of what they have given out by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..staging import staged_path
from ..streaming import ordered
from .catalog import longs, query, r6s, table

_SESSIONS = """
e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k)
"""


def _plain(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"WITH {_SESSIONS} SELECT * FROM g")
def user_sessions(spark, sf_dir):
    rows = ordered.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", value="value")
    return _plain(rows).select("user_id", "start", "end", *longs("n"), *r6s("total"))


@query(f"""WITH {_SESSIONS} SELECT * FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """What a stream over the whole table has closed when all of it is read; the open sessions wait in its state."""
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")  # a pattern also takes a single file
    target, checkpoint = staged_path(spark, "sessions"), staged_path(spark, "sessions-checkpoint")
    ordered.append(ordered.sessions(stream, "user_id", "ts", "6 hours", "1 hour", "value"), target, checkpoint)
    return _plain(spark.read.parquet(target)).select("user_id", "start", "end", *longs("n"), *r6s("total"))


@query("""
WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 9 HOUR]) AS start FROM events)
SELECT user_id, start, start + INTERVAL 12 HOUR AS "end", count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 3
""")
def sliding_quota(spark, sf_dir):
    rows = ordered.quota_windows(table(spark, sf_dir, "events"), "user_id", "ts", 3, "12 hours", "3 hours")
    return _plain(rows).select("user_id", "start", "end", *longs("n"))
