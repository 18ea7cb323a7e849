"""Incremental exposure: a stream-stream interval join of observations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lag import kernel


def streaming_exposure(observations: DataFrame, events: DataFrame, kernels: DataFrame, late: str = "1 hour") -> DataFrame:
    """(diary_id, obs_id, item, k, w) of streams with a column ts, one row per match.

    Both sides carry a watermark; the time condition bounds the state to 84 hours.
    """
    o = observations.withColumnRenamed("ts", "obs_ts").withWatermark("obs_ts", late)
    e = events.withColumnsRenamed({"ts": "event_ts", "diary_id": "of"}).withWatermark("event_ts", late)
    joined = o.join(e, F.expr("diary_id = of and obs_ts >= event_ts + interval 15 minutes and obs_ts <= event_ts + interval 84 hours"))
    d = (F.unix_micros("obs_ts") - F.unix_micros("event_ts")) / F.lit(3.6e9)
    return (
        joined.withColumn("d", d).join(F.broadcast(kernels), F.abs(F.col("d") - F.col("c")) < F.col("w"))
        .select("diary_id", "obs_id", "item", "k", kernel(F.col("d"), F.col("c"), F.col("w")).alias("weight"))
    )
