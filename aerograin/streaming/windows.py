"""Structured Streaming forms of the window, session and detector operators, each with a batch twin to compare with.

Windows of the batch operators are (start, end]; Spark's are [start, end), so event times are moved back by a microsecond
before they are cut into windows. Late rows: up to `late` behind the newest event time are taken, later ones are dropped;
the batch operators read everything again and have no such rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import Scratch


def sliding(df: DataFrame, key: str, time: str, value: str, length: str = "15 minutes", every: str = "5 minutes", late: str | None = "2 minutes") -> DataFrame:
    """key, window_end, n, mean of `value` over (end - length, end]."""
    x = df.withColumn("_t", F.col(time).cast("timestamp") - F.expr("interval 1 microsecond"))
    if late is not None and df.isStreaming:
        x = x.withWatermark("_t", late)
    g = x.groupBy(F.window("_t", length, every).alias("w"), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return g.select(key, F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "mean")


def sessions(df: DataFrame, key: str, time: str, gap: str = "10 minutes", late: str | None = "10 minutes") -> DataFrame:
    """key, start, end, n of each stretch of rows without a longer gap."""
    x = df.withColumn("_t", F.col(time).cast("timestamp"))
    if late is not None and df.isStreaming:
        x = x.withWatermark("_t", late)
    g = x.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("_t").alias("last"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("end"), "n")


HAMPEL = "key bigint, ts timestamp, value double, is_outlier boolean"


def hampel_stream(df: DataFrame, window: int = 11, k: float = 3.0) -> DataFrame:
    """key, ts, value, is_outlier for a stream (key bigint, ts, value): the last window - 1 values of each key are the state.

    Within a trigger a key's rows are put in order; triggers must come in order of time (a source that reads files by age
    does). How many rows a key has in one trigger is bounded by the source's own limit on files a trigger.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values(["ts", "value"], kind="stable")  # one key's rows of one trigger
        x = np.concatenate([np.array(last, float), f["value"].to_numpy(float)])
        flags = np.zeros(len(x), bool)
        if len(x) >= window:
            w = np.lib.stride_tricks.sliding_window_view(x, window)
            m = np.median(w, axis=1)
            mad = np.median(np.abs(w - m[:, None]), axis=1) * 1.4826
            far = np.abs(x[window - 1 :] - m)
            flags[window - 1 :] = ~np.isnan(m) & np.where(mad > 0, far > k * mad, far != 0)
        state.update((x[-(window - 1) :].tolist(),))
        yield f.assign(is_outlier=flags[len(last) :])[["key", "ts", "value", "is_outlier"]]

    return df.groupBy("key").applyInPandasWithState(step, HAMPEL, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def upserted(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stream over all that is there and return the last version of each key: update mode, one written table a batch,
    last writer wins. Needs no transactional sink."""
    spark = stream.sparkSession
    scratch = Scratch(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{scratch.base}/batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{scratch.base}-state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(scratch.base)
    cols = [c for c in got.columns if c not in (*keys, "_batch", "batch")]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in cols])


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that is there and return what it wrote."""
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{scratch.base}/out").option("checkpointLocation", f"{scratch.base}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.base}/out")
