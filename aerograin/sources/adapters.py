"""Sensor-shaped views over `events`, by arithmetic alone, with the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home, time, pm25, pm10, co2, t, rh: four homes, one reading an hour, an hour left out after every ten, some readings null."""
    e = table(spark, sf_dir, "events")
    ok = ~((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0))
    when = lambda x: F.when(ok, x)
    return e.select(
        (F.col("event_id") % 4).alias("home"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(event_id div 4 + event_id div 40 as int))").alias("time"),
        when(F.col("value") * 0.5).alias("pm25"),
        when(F.col("value") * 0.6).alias("pm10"),
        when(380 + F.col("value") * 8).alias("co2"),
        when(14 + (F.col("event_id") * 7 % 160) / 10.0).alias("t"),
        when(12 + (F.col("event_id") * 13 % 800) / 10.0).alias("rh"),
    )


HOURLY = """readings AS (
  SELECT event_id % 4 AS home, TIMESTAMP '2024-01-01' + to_hours(CAST(event_id // 4 + event_id // 40 AS BIGINT)) AS time,
    CASE WHEN ok THEN value * 0.5 END AS pm25, CASE WHEN ok THEN value * 0.6 END AS pm10,
    CASE WHEN ok THEN 380 + value * 8 END AS co2,
    CASE WHEN ok THEN 14 + (event_id * 7 % 160) / 10.0::DOUBLE END AS t,
    CASE WHEN ok THEN 12 + (event_id * 13 % 800) / 10.0::DOUBLE END AS rh
  FROM (SELECT *, NOT (event_type = 'error' AND event_id % 5 = 0) AS ok FROM events))"""


def readings_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, ts, pm1, pm2_5, pm4, pm10, co2, temperature, temperature2, humidity, humidity2, status: about 30 s apart, with
    jitter, gaps, stuck stretches, broken PM order (with and without a missing fraction), stretches of bad air, failing and disabled devices."""
    e = table(spark, sf_dir, "events")
    slot = F.expr("event_id div 4 + event_id div 48")
    pm = F.when(slot % 400 >= 340, 75 + F.col("value") * 0.1).when(slot % 50 < 6, F.lit(12.0)).otherwise(F.col("value") * 0.4)
    return (
        e.select("event_id", "event_type", "value", slot.alias("slot"), pm.alias("pm2_5"))
        .select(
            (F.col("event_id") % 4).alias("device"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(slot * 30 + event_id % 7 as decimal(18,6)))").alias("ts"),
            F.when(F.col("event_id") % 34 != 0, F.col("pm2_5") * 0.9).alias("pm1"),
            "pm2_5",
            (F.col("pm2_5") * 1.05).alias("pm4"),
            F.when(F.col("event_id") % 17 == 0, F.col("pm2_5") * 0.5).otherwise(F.col("pm2_5") * 1.1).alias("pm10"),
            (F.when(F.col("slot") % 600 >= 520, F.lit(1900.0)).otherwise(F.lit(350.0)) + F.col("value") * 6).alias("co2"),
            (18 + (F.col("slot") * 7 % 80) / 10.0).alias("temperature"),
            (18 + (F.col("slot") * 7 % 80) / 10.0 + (F.col("event_id") % 3)).alias("temperature2"),
            (20 + (F.col("slot") * 13 % 500) / 10.0).alias("humidity"),
            (20 + (F.col("slot") * 13 % 500) / 10.0 + (F.col("event_id") % 9)).alias("humidity2"),
            F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "Failed").when(F.col("event_id") % 101 == 0, "disabled").when((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), "partial").otherwise("ok").alias("status"),
        )
    )


S30 = """readings30 AS (
  SELECT event_id % 4 AS device, TIMESTAMP '2024-01-01' + to_seconds(slot * 30 + event_id % 7) AS ts,
    CASE WHEN event_id % 34 <> 0 THEN pm2_5 * 0.9 END AS pm1, pm2_5, pm2_5 * 1.05 AS pm4, CASE WHEN event_id % 17 = 0 THEN pm2_5 * 0.5 ELSE pm2_5 * 1.1 END AS pm10,
    CASE WHEN slot % 600 >= 520 THEN 1900.0 ELSE 350.0 END + value * 6 AS co2, 18 + (slot * 7 % 80) / 10.0::DOUBLE AS temperature, 18 + (slot * 7 % 80) / 10.0::DOUBLE + event_id % 3 AS temperature2,
    20 + (slot * 13 % 500) / 10.0::DOUBLE AS humidity, 20 + (slot * 13 % 500) / 10.0::DOUBLE + event_id % 9 AS humidity2,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Failed' WHEN event_id % 101 = 0 THEN 'disabled' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'partial' ELSE 'ok' END AS status
  FROM (SELECT *, CASE WHEN slot % 400 >= 340 THEN 75 + value * 0.1 WHEN slot % 50 < 6 THEN 12.0 ELSE value * 0.4 END AS pm2_5 FROM (SELECT *, event_id // 4 + event_id // 48 AS slot FROM events)))"""
