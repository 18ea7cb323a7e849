"""Lag kernels, control terms and time arithmetic as column functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Centres and half-widths of the lag kernels, in hours.
CENTERS = (2.0, 5.0, 9.0, 15.0, 24.0, 40.0, 60.0)
WIDTHS = (3.0, 4.0, 5.0, 8.0, 12.0, 18.0, 24.0)
LEAST, MOST = 0.25, 84.0
BANDS = {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}


def hours(ts: Column) -> Column:
    """Hours since the epoch of a timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(3.6e9)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def kernel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, w) for k, (c, w) in enumerate(zip(CENTERS, WIDTHS))], "k int, c double, w double")


def register_kernels(spark: SparkSession, name: str = "lag_kernels") -> None:
    """The SQL table function ``lag_kernels(d)``: (k, weight) of every kernel at a delay of d hours."""
    rows = ", ".join(f"({k}, {c}D, {w}D)" for k, (c, w) in enumerate(zip(CENTERS, WIDTHS)))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(d DOUBLE) RETURNS TABLE (k INT, weight DOUBLE) RETURN "
        f"SELECT k, CASE WHEN abs(({name}.d - c) / w) < 1 AND {name}.d >= {LEAST} THEN 0.5D * (1 + cos(pi() * (({name}.d - c) / w))) ELSE 0D END "
        f"FROM VALUES {rows} AS t(k, c, w)"
    )


def since_first(ts: Column, order: Column, by: list[str] | None = None) -> Column:
    """Hours since the row that comes first by ``order``, which need not be the earliest."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hours(ts) - F.first(hours(ts)).over(window)


def kernel(d: Column, c: Column, w: Column) -> Column:
    u = (d - c) / w
    return F.when((F.abs(u) < 1) & (d >= LEAST), 0.5 * (1 + F.cos(F.lit(math.pi) * u))).otherwise(0.0)


def kernel_weights(d: np.ndarray) -> np.ndarray:
    """(n, 7) weights of delays."""
    u = (np.asarray(d, float)[:, None] - np.array(CENTERS)) / np.array(WIDTHS)
    return np.where((np.abs(u) < 1) & (np.asarray(d)[:, None] >= LEAST), 0.5 * (1 + np.cos(np.pi * u)), 0.0)


def bump(d: Column, center, width: float = 7.0) -> Column:
    """The simulator's single response: 0 before the event and beyond the width."""
    u = (d - center) / width
    return F.when((F.abs(u) < 1) & (d >= 0), 0.5 * (1 + F.cos(F.lit(math.pi) * u))).otherwise(0.0)


def bump_values(d: np.ndarray, center: float, width: float = 7.0) -> np.ndarray:
    u = (d - center) / width
    return np.where((np.abs(u) < 1) & (d >= 0), 0.5 * (1 + np.cos(np.pi * u)), 0.0)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
