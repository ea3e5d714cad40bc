"""Streaming queries, run over all rows at hand; the SQL is the batch form of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import table
from ..streaming import windows


def events_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def stream_sliding_means(spark, sf_dir):
    x = events_stream(spark, sf_dir).withColumn("device", F.col("user_id") % 4)
    s = windows.sliding(x, "device", "ts", "value", "2 hours", "1 hour", "2 hours")
    return windows.upserted(s, ["device", "window_end"], "sliding").select("device", "window_end", "n", F.round("mean", 6).alias("mean"))


def stream_sessions(spark, sf_dir):
    """Sessions of a real stream, two hours late at most: those the watermark has closed, and the open ones from the rows after them."""
    closed = windows.appended(windows.sessions(events_stream(spark, sf_dir), "user_id", "ts", "6 hours", "2 hours"), "sessions")
    until = closed.groupBy("user_id").agg(F.max("end").alias("until"))
    rest = table(spark, sf_dir, "events").select("user_id", "ts").join(until, "user_id", "left").where("until is null or ts > until")
    return closed.unionByName(windows.sessions(rest, "user_id", "ts", "6 hours", None)).select("user_id", "start", "end", "n")


def stream_hampel(spark, sf_dir):
    x = events_stream(spark, sf_dir).select((F.col("user_id") % 4).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    got = windows.appended(windows.hampel_stream(x), "hampel")
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))


QUERIES = {f.__name__: f for f in (stream_sliding_means, stream_sessions, stream_hampel)}

SQL = {
    "stream_sliding_means": """WITH e AS (SELECT user_id % 4 AS device, value, epoch_us(ts) - 1 AS us FROM events),
w AS (SELECT device, value, (us // 3600000000 + unnest([1, 2])) * 3600000000 AS e FROM e)
SELECT device, make_timestamp(e) AS window_end, count(value) AS n, round(avg(value), 6) AS mean FROM w GROUP BY device, e""",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000, false)::INT AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_hampel": """WITH e AS (SELECT user_id % 4 AS key, ts, value FROM events),
l AS (SELECT *, list(value) OVER w AS l FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, value ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, CASE WHEN len(l) = 11 THEN list_aggregate(l, 'median') END AS med FROM l), b AS (SELECT *, list_aggregate(list_transform(l, lambda y: abs(y - med)), 'median') * 1.4826 AS mad FROM a)
SELECT key, count(*) AS n, count_if(med IS NOT NULL AND CASE WHEN mad > 0 THEN abs(value - med) > 3.0 * mad ELSE value <> med END)::BIGINT AS n_outliers FROM b GROUP BY key""",
}
