"""Exposure series of a diary for plotting: chosen, in order of time, as a table, a file or a picture."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lag import CENTERS

#: Readings of one diary that a plot takes at most; more are an error.
MOST_POINTS = 1_000_000
TERMINALS = {".png": "pngcairo", ".svg": "svg", ".pdf": "pdfcairo"}

Choice = int | tuple[str, int | None]


def chosen(items: Sequence[str], columns: Sequence[Choice] | None = None) -> list[tuple[str, str, int | None]]:
    """(label, item, kernel or None for all) of each series asked for; without a choice every item's total.

    A number is a column of the exposure matrix: the item's place in ``items`` times the kernels, plus the kernel.
    """
    out = []
    for choice in [(i, None) for i in items] if columns is None else columns:
        if isinstance(choice, int):
            place, k = divmod(choice, len(CENTERS))
            if not 0 <= place < len(items):
                raise ValueError(f"no column {choice}: there are {len(items) * len(CENTERS)}")
            out.append((f"column {choice}", items[place], k))
            continue
        item, k = choice
        if item not in items:
            raise ValueError(f"unknown item {item!r}")
        if k is not None and not 0 <= k < len(CENTERS):
            raise ValueError(f"no kernel {k}: there are {len(CENTERS)}")
        out.append((f"{item}, all delays" if k is None else f"{item}, {CENTERS[k]:g} h", item, k))
    return out


def series(observations: DataFrame, x: DataFrame, items: Sequence[str], columns: Sequence[Choice] | None = None, item: str = "item") -> DataFrame:
    """(diary_id, obs_id, t_h, series, label, value): every chosen series at every reading, 0 without exposure.

    ``x`` is a long exposure (diary_id, obs_id, item, k, x).
    """
    spark = observations.sparkSession
    wanted = spark.createDataFrame([(n, label, i, k) for n, (label, i, k) in enumerate(chosen(items, columns))], "series int, label string, of string, kernel int")
    # one row for each series of a picture
    wanted = F.broadcast(wanted)
    found = x.join(wanted, F.expr(f"{item} = of and (kernel is null or kernel = k)")).groupBy("diary_id", "obs_id", "series").agg(F.sum("x").alias("value"))
    grid = observations.select("diary_id", "obs_id", "t_h").crossJoin(wanted.select("series", "label"))
    return grid.join(found, ["diary_id", "obs_id", "series"], "left").select("diary_id", "obs_id", "t_h", "series", "label", F.coalesce("value", F.lit(0.0)).alias("value"))


def table(rows: DataFrame) -> tuple[list[str], list[tuple[float, ...]]]:
    """Labels, and (t_h, value of each series) in order of time, of one diary's series."""
    labels = [r["label"] for r in rows.select("series", "label").distinct().orderBy("series").collect()]
    values = F.transform(F.array_sort(F.collect_list(F.struct("series", "value"))), lambda v: v["value"])
    lines = rows.groupBy("obs_id", "t_h").agg(values.alias("values")).orderBy("t_h", "obs_id").limit(MOST_POINTS + 1).collect()
    if len(lines) > MOST_POINTS:
        raise ValueError(f"over {MOST_POINTS} readings; choose one diary")
    return labels, [(r["t_h"], *r["values"]) for r in lines]


def write_table(rows: DataFrame, path: str) -> list[str]:
    """Tab-separated lines of :func:`table` under a commented title; returns the labels."""
    labels, lines = table(rows)
    with open(path, "w", encoding="utf-8") as f:
        print("# t", *(f'"{label}"' for label in labels), sep="\t", file=f)
        for line in lines:
            print(*(f"{v:.6g}" for v in line), sep="\t", file=f)
    return labels


def script(data: str, labels: Sequence[str], picture: str | None = None, title: str | None = None, xlabel: str = "time (h)", ylabel: str = "exposure", terminal: str = "qt") -> str:
    """Commands that draw the lines of a table."""
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"set xlabel {quoted(xlabel)}", f"set ylabel {quoted(ylabel)}", "set grid", "set key outside right"]
    lines += [f"set title {quoted(title)}"] if title else []
    if picture:
        kind = TERMINALS.get(os.path.splitext(picture)[1].lower(), TERMINALS[".png"])
        lines += [f"set terminal {kind} size 1000,600", f"set output {quoted(picture)}"]
    else:
        lines.append(f"set terminal {terminal} persist")
    drawn = (f"{quoted(data)} using 1:{n} with lines lw 2 title {quoted(label)}" for n, label in enumerate(labels, 2))
    return "\n".join([*lines, "plot " + ", ".join(drawn), ""])


def draw(rows: DataFrame, path: str, picture: str | None = None, **decoration: str) -> str | None:
    """Writes the table to ``path`` and has gnuplot draw it; returns the picture's path, if one is asked for."""
    commands = script(path, write_table(rows, path), picture, **decoration)
    if shutil.which("gnuplot") is None:
        raise RuntimeError(f"gnuplot is not installed; the table is in {path}")
    subprocess.run(["gnuplot"], input=commands, text=True, check=True)
    return picture

