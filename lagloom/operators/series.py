"""Windows over observations: gaps, whitening weights, day blocks, controls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lag import clip



def ordered():
    """A diary's observations in time."""
    return Window.partitionBy("diary_id").orderBy("t_h", "obs_id")


def whole():
    return Window.partitionBy("diary_id")


def gaps(obs: DataFrame) -> DataFrame:
    """Adds dt, hours since the observation before."""
    return obs.withColumn("dt", F.col("t_h") - F.lag("t_h").over(ordered()))


def median_gap(obs: DataFrame) -> DataFrame:
    return gaps(obs).groupBy("diary_id").agg(F.percentile("dt", 0.5).alias("median_dt"))


def rho(residuals: DataFrame, r: str = "r") -> DataFrame:
    """Lag-1 autocorrelation of residuals per diary, between 0 and 0.9."""
    back = residuals.withColumn("_p", F.lag(r).over(ordered()))
    num, den = F.sum(F.col("_p") * F.col(r)), F.sum(F.col("_p") * F.col("_p"))
    return back.groupBy("diary_id").agg(clip(F.coalesce(num, F.lit(0.0)) / F.greatest(F.coalesce(den, F.lit(0.0)), F.lit(1e-9)), 0.0, 0.9).alias("rho"))


def demeaned(obs: DataFrame) -> DataFrame:
    return obs.withColumn("r", F.col("y") - F.avg("y").over(whole()))


def whitened(obs: DataFrame) -> DataFrame:
    """(diary_id, obs_id, w, y_w): y minus rho to the power of the relative gap times y before."""
    d = gaps(demeaned(obs)).withColumn("_y", F.lag("y").over(ordered()))
    w = F.pow("rho", F.col("dt") / F.greatest("median_dt", F.lit(1e-6)))
    return (
        d.join(rho(demeaned(obs)), "diary_id").join(median_gap(obs), "diary_id").where("dt is not null")
        .withColumn("w", w).select("diary_id", "obs_id", "w", (F.col("y") - F.col("w") * F.col("_y")).alias("y_w"))
    )


def day_blocks(obs: DataFrame, days: int = 3) -> DataFrame:
    """(diary_id, day, block): consecutive observed days, by threes."""
    origin = F.min("t_h").over(whole())
    day = obs.select("diary_id", F.floor((F.col("t_h") - origin) / 24).cast("long").alias("day")).distinct()
    place = F.row_number().over(Window.partitionBy("diary_id").orderBy("day")) - 1
    return day.withColumn("block", F.floor(place / days).cast("long"))


def controls(obs: DataFrame, hod: Column) -> DataFrame:
    """Adds z0 to z5: constant, two day cycles, drift in days."""
    turn = lambda f, n: f(F.lit(2 * n * math.pi) * hod / 24)
    return obs.select(
        "*", F.lit(1.0).alias("z0"), turn(F.sin, 1).alias("z1"), turn(F.cos, 1).alias("z2"),
        turn(F.sin, 2).alias("z3"), turn(F.cos, 2).alias("z4"),
        ((F.col("t_h") - F.avg("t_h").over(whole())) / 24).alias("z5"),
    )


def drift_residual(obs: DataFrame) -> DataFrame:
    """y without its straight-line drift in time, per diary (one regressor and a constant)."""
    fit = obs.groupBy("diary_id").agg(F.regr_slope("y", "t_h").alias("slope"), F.avg("y").alias("my"), F.avg("t_h").alias("mt"))
    return obs.join(fit, "diary_id").select(
        "diary_id", "obs_id", (F.col("y") - F.col("my") - F.coalesce("slope", F.lit(0.0)) * (F.col("t_h") - F.col("mt"))).alias("r")
    )


def orthonormal(z: DataFrame) -> DataFrame:
    """(diary_id, obs_id, q): the columns ``z`` of each diary made orthonormal; null columns where they depend on one another."""
    import numpy as np
    import pandas as pd

    def turned(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = np.linalg.qr(np.stack(pdf["z"].to_numpy()))
        q = q * (np.abs(np.diag(r)) > 1e-9)
        return pd.DataFrame({"diary_id": pdf["diary_id"], "obs_id": pdf["obs_id"], "q": list(q)})

    return z.groupBy("diary_id").applyInPandas(turned, "diary_id long, obs_id long, q array<double>")
