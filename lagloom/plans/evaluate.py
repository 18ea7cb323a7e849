"""Detection quality on synthetic diaries with known truth."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simulate
from .analyze import analyze


def diary_scores(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(diary_id, recall, precision, err_lag_h, false_positives) of truth(diary_id, item, lag_h).

    A selected block is a hit if it holds a true item; precision is 1 where nothing is selected.
    """
    chosen = results.where("selected").select("diary_id", "block", F.col("lag_h").alias("found_h"), F.explode(F.split("block", r"\+")).alias("item"))
    hits = truth.join(chosen, ["diary_id", "item"]).withColumn("err", F.abs(F.col("found_h") - F.col("lag_h")))
    h = hits.groupBy("diary_id").agg(F.countDistinct("item").alias("n_hit"), F.countDistinct("block").alias("blocks_hit"), F.median("err").alias("err_lag_h"))
    t = truth.groupBy("diary_id").agg(F.count("*").alias("n_true"))
    s = results.where("selected").groupBy("diary_id").agg(F.count("*").alias("n_selected"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.join(h, "diary_id", "left").join(s, "diary_id", "left").select(
        "diary_id", (zero("n_hit") / F.col("n_true")).alias("recall"),
        F.when(zero("n_selected") == 0, 1.0).otherwise(zero("blocks_hit") / F.col("n_selected")).alias("precision"),
        "err_lag_h", (zero("n_selected") - zero("blocks_hit")).alias("false_positives"),
    )


def delay_errors(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(diary_id, block, err) of each selected block that holds a true item: hours from the mean of its true delays."""
    chosen = results.where("selected").select("diary_id", "block", F.col("lag_h").alias("found_h"), F.explode(F.split("block", r"\+")).alias("item"))
    near = truth.join(chosen, ["diary_id", "item"]).groupBy("diary_id", "block").agg(F.avg("lag_h").alias("true_h"), F.first("found_h").alias("found_h"))
    return near.where("found_h is not null").select("diary_id", "block", F.abs(F.col("found_h") - F.col("true_h")).alias("err"))


def false_positives(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Selected blocks without a true item, by how often."""
    chosen = results.where("selected").select("diary_id", "block", F.explode(F.split("block", r"\+")).alias("item"))
    hit = chosen.join(truth, ["diary_id", "item"], "left_semi").select("diary_id", "block").distinct()
    return results.where("selected").join(hit, ["diary_id", "block"], "left_anti").groupBy("block").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "block")


def evaluate(
    spark: SparkSession, n_seeds: int = 12, n_days: int = 28, reading_hours=(), replicates: int = 120, threshold: float = 0.7, first_seed: int = 0,
    culprits: dict = simulate.CULPRITS, **setup,
) -> dict:
    """Mean recall and precision and the median delay error over seeds; diaries with an error don't count.

    All diaries are one analysis, so they run in parallel as far as there are cores. ``false_positives`` is a
    dictionary of blocks and how often each was selected without holding a culprit.
    """
    s = replace(simulate.Setup(n_days=n_days, reading_hours=tuple(reading_hours)), **setup)
    obs, entries, relievers = simulate.split(simulate.generate(spark, n_seeds, s, first_seed, culprits).persist())
    results, stats, _ = analyze(obs, entries, relievers, replicates=replicates, threshold=threshold)
    good = stats.where("error is null").select("diary_id").persist()
    known = spark.createDataFrame([(i, lag) for i, lag, _ in simulate.truth(culprits, s.reliever, s.lang)], "item string, lag_h double")
    truth = good.crossJoin(F.broadcast(known))
    scores = diary_scores(results, truth)
    row = scores.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.count("*").alias("n_seeds")).first()
    errors = delay_errors(results, truth).agg(F.median("err")).first()[0]
    wrong = {r["block"]: r["n"] for r in false_positives(results, truth).collect()}
    readings = obs.join(good, "diary_id", "left_semi").groupBy("diary_id").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0]
    return row.asDict() | {"err_lag_h": errors, "false_positives": wrong, "n_obs": readings}
