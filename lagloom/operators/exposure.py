"""The lag range join and the exposures made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lag import BANDS, CENTERS, LEAST, MOST, WIDTHS, kernel


def lag_join(observations: DataFrame, events: DataFrame, bucket_h: float = MOST) -> DataFrame:
    """Observations with the events 0.25 to 84 hours before them, and the delay d.

    Both sides carry diary_id and t_h. An event falls into one bucket of ``bucket_h`` hours, an
    observation looks into the buckets that its window reaches, so the join is an equi-join on (diary,
    bucket): it shuffles by key or broadcasts, is split by adaptive execution where a burst makes a
    bucket heavy, and never becomes a nested loop.
    """
    back = -(-MOST // bucket_h)
    o = observations.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor(t_h / {bucket_h}) as long) - {int(back)}, cast(floor(t_h / {bucket_h}) as long))")))
    e = events.withColumnRenamed("t_h", "event_h").withColumn("_b", F.floor(F.col("event_h") / bucket_h).cast("long"))
    delay = F.col("t_h") - F.col("event_h")
    return o.join(e, ["diary_id", "_b"]).where(delay.between(LEAST, MOST)).drop("_b").withColumn("d", delay)


def exposure(observations: DataFrame, events: DataFrame, item: str = "item") -> DataFrame:
    """Sparse long exposure (diary_id, obs_id, item, k, x): kernel weights summed over events.

    All kernels are summed in one row per (observation, item), and only then become rows of their
    own, so the shuffle carries one row where up to seven would match.
    """
    d = F.col("d")
    weights = [
        F.sum(F.when(F.abs(d - c) < w, kernel(d, F.lit(c), F.lit(w)))) for c, w in zip(CENTERS, WIDTHS)
    ]
    pairs = lag_join(observations.select("diary_id", "obs_id", "t_h"), events.select("diary_id", "t_h", item))
    return (
        pairs.groupBy("diary_id", "obs_id", item).agg(F.array(*weights).alias("_w"))
        .select("diary_id", "obs_id", item, F.posexplode("_w").alias("k", "x")).where("x is not null")
    )


def signed(x: DataFrame, relievers: DataFrame, item: str = "item") -> DataFrame:
    """Exposures of relievers with a minus."""
    r = relievers.select(F.col(item).alias("_r")).distinct()
    return x.join(r, x[item] == r["_r"], "left").withColumn("x", F.when(F.col("_r").isNotNull(), -F.col("x")).otherwise(F.col("x"))).drop("_r")


def bands(x: DataFrame, item: str = "item") -> DataFrame:
    """Kernels gathered into three bands: short, middle, long delays."""
    band = F.when(F.col("k") < 2, BANDS[0]).when(F.col("k") < 5, BANDS[2]).otherwise(BANDS[5])
    return x.groupBy("diary_id", "obs_id", item, band.alias("band")).agg(F.sum("x").alias("x"))


def series(x: DataFrame, item: str = "item") -> DataFrame:
    """One total per observation and item, as plotted."""
    return x.groupBy("diary_id", "obs_id", item).agg(F.sum("x").alias("x"))


def gram(x: DataFrame, column: str) -> DataFrame:
    """Products of exposure columns summed over observations: (i, j, s) for i <= j."""
    a = x.select("diary_id", "obs_id", F.col(column).alias("i"), F.col("x").alias("a"))
    b = x.select("diary_id", "obs_id", F.col(column).alias("j"), F.col("x").alias("b"))
    return a.join(b, ["diary_id", "obs_id"]).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))


def gram_blocks(x: DataFrame, item: str = "item") -> DataFrame:
    """Products of exposure columns (item, k) summed over the observations of a day block, upper half.

    ``x`` carries ``block``. An observation's columns meet by (diary, observation), so rows follow the squared number of
    items within 84 hours of a reading, never of the vocabulary.
    """
    side = lambda name: x.select("diary_id", "block", "obs_id", F.col(item).alias(f"{name}_item"), F.col("k").alias(f"{name}_k"), F.col("x").alias(f"{name}_x"))
    pairs = side("i").join(side("j"), ["diary_id", "block", "obs_id"]).where("struct(i_item, i_k) <= struct(j_item, j_k)")
    return pairs.groupBy("diary_id", "block", "i_item", "i_k", "j_item", "j_k").agg(F.sum(F.col("i_x") * F.col("j_x")).alias("s"))
