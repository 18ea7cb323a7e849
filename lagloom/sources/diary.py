"""Diary files (CSV or ODS) as observations, entries and relievers, with diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lag import hour_of_day
from ..functions.text import near_names, normalize_column, number, parsed_date, parsed_minutes
from .i18n import DATE_FORMATS, REQUIRED
from .ods import canonical, filled, numbered, read_ods

NOON = 12 * 60


def read_lines(spark: SparkSession, path: str, sheet: str | None = None, lang: str = "en") -> DataFrame:
    """Text columns under canonical names, and line_no; the format goes by the suffix."""
    if path.lower().endswith((".ods", ".fods")):
        return read_ods(spark, path, sheet, lang)
    head = spark.read.csv(path, header=False, encoding="UTF-8", multiLine=True, escape='"').limit(1).take(1)
    if not head:
        return spark.createDataFrame([], "line_no int")
    titles = [(t or "").removeprefix("﻿") for t in head[0]]
    schema = ", ".join(f"_{i} string" for i in range(len(titles)))
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, encoding="UTF-8", multiLine=True, escape='"')
    cols = [F.coalesce(f"_{i}", F.lit("")).alias(n) for n, i in canonical(titles, lang).items()]
    return raw.withColumn("row_no", F.monotonically_increasing_id()).where(filled(*raw.columns)).select("row_no", *cols).transform(numbered)


def parse(lines: DataFrame, lang: str = "en") -> DataFrame:
    """Adds ts, items, relievers, outcome and the problems of each line; rows without a readable date have no ts."""
    for c in (*REQUIRED, "time", "medications"):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(""))
    text = lambda c: F.trim(F.col(c))
    date, minutes = parsed_date(F.col("date"), DATE_FORMATS.get(lang, DATE_FORMATS["en"])), parsed_minutes(F.col("time"))
    outcome = number(F.col("pain"))
    ts = F.timestamp_add("MINUTE", F.coalesce(minutes, F.lit(NOON)), date.cast("timestamp_ntz"))
    return lines.select(
        "line_no", ts.alias("ts"), F.col("foods"), F.col("medications"), outcome.alias("outcome"),
        F.when(text("date") == "", "blank_date").when(date.isNull(), "bad_date").alias("date_problem"),
        F.when(text("time") == "", "default_time").when(minutes.isNull(), "bad_time").alias("time_problem"),
        F.when((text("pain") != "") & outcome.isNull(), "bad_outcome").alias("outcome_problem"),
        text("date").alias("date_text"), text("time").alias("time_text"), text("pain").alias("outcome_text"),
    )


def _items(rows: DataFrame, column: str) -> DataFrame:
    """(line_no, items): normalised, distinct, sorted."""
    parts = rows.select("line_no", F.explode(F.split(column, ";")).alias("_name"))
    return normalize_column(parts, "_name", "item").where("item <> ''").groupBy("line_no").agg(F.array_sort(F.collect_set("item")).alias("items"))


def load(spark: SparkSession, path: str, sheet: str | None = None, lang: str = "en", diary_id: int = 0):
    """(observations, entries, relievers, diagnostics) of one diary file."""
    lines = read_lines(spark, path, sheet, lang)
    missing = [c for c in REQUIRED if c not in lines.columns]
    parsed = parse(lines, lang)
    good = parsed.where("ts is not null")
    start = Window.partitionBy(F.lit(0))
    timed = good.withColumn("t_h", (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(start)) / 3.6e9)
    me = F.lit(diary_id).cast("long").alias("diary_id")
    number_ = F.col("line_no").cast("long")
    obs = timed.where("outcome is not null").select(me, number_.alias("obs_id"), "t_h", hour_of_day(F.col("ts")).alias("hod"), F.col("outcome").alias("y"))
    side = lambda c: timed.join(_items(good, c), "line_no").select(me, number_.alias("entry_id"), "t_h", "items")
    entries, relievers = side("foods"), side("medications")
    said = lambda cond, code, arg: parsed.where(cond).select(me, F.col("line_no").cast("long").alias("line_no"), F.lit(code).alias("code"), F.col(arg).alias("arg"))
    names = entries.select(F.explode("items").alias("item")).unionByName(relievers.select(F.explode("items").alias("item"))).distinct()
    kept = F.col("ts").isNotNull()
    out = [
        said("date_problem = 'bad_date'", "bad_date", "date_text"),
        said(kept & (F.col("time_problem") == "bad_time"), "bad_time", "time_text"),
        said(kept & F.col("outcome_problem").isNotNull(), "bad_outcome", "outcome_text"),
        parsed.where(kept & (F.col("time_problem") == "default_time")).agg(F.count("*").alias("n")).where("n > 0").select(me, F.lit(None).cast("long").alias("line_no"), F.lit("default_time").alias("code"), F.col("n").cast("string").alias("arg")),
        good.agg(F.count("*").alias("n")).where("n = 0").select(me, F.lit(None).cast("long").alias("line_no"), F.lit("no_lines").alias("code"), F.lit(None).cast("string").alias("arg")),
        near_names(names).select(me, F.lit(None).cast("long").alias("line_no"), F.lit("similar_names").alias("code"), F.concat_ws(", ", "a", "b").alias("arg")),
    ]
    if missing:
        out.append(spark.createDataFrame([(diary_id, None, "missing_column", c) for c in missing], "diary_id long, line_no long, code string, arg string"))
    diagnostics = out[0]
    for d in out[1:]:
        diagnostics = diagnostics.unionByName(d)
    return obs, entries, relievers, diagnostics
