"""Command line: analyse a diary, write an example, validate detection quality."""

from __future__ import annotations

import argparse
import csv
import datetime
import os
import sys

from .session import builder
from .sources.i18n import HEADERS, item_name, language, message

DURATIONS = (21, 28, 42, 56, 84)


def example_rows(days: int = 42, lang: str = "en", seed: int = 0, reading_hours=None, reliever=None) -> tuple[list[list[str]], list[tuple[str, float, float]]]:
    """Text rows of a synthetic diary, in order of time, under the language's column names; and its truth."""
    from .plans.simulate import READING_HOURS, RELIEVER, SLOTS, Setup, one_diary, truth

    reliever = RELIEVER if reliever is None else reliever
    hours = READING_HOURS if reading_hours is None else tuple(reading_hours)
    setup = Setup(n_days=days, reading_hours=hours, reliever=reliever or None, lang=lang)
    meals, doses, readings = one_diary(seed, setup)
    foods, pills = dict(meals), dict(doses)
    titles = {v: k for k, v in HEADERS.get(lang, HEADERS["en"]).items()}
    out = [[titles[c] for c in ("date", "time", "meal", "foods", "medications", "pain")]]
    for t, hour, y in readings:
        at = datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=t)
        day = f"{at:%d/%m/%Y}" if lang == "fr" else f"{at.month}/{at.day}/{at:%y}"
        slot = item_name(min(SLOTS, key=lambda s: abs(hour - s[1]))[0], lang) if t in foods else ""
        out.append([day, f"{at:%H:%M}", slot, "; ".join(foods.get(t, [])), "; ".join(pills.get(t, [])), f"{y:g}"])
    return out, truth(reliever=setup.reliever, lang=lang)


def write_example(path: str, days: int = 42, lang: str = "en", seed: int = 0, reading_hours=None, reliever=None) -> list[tuple[str, float, float]]:
    """Writes a synthetic diary, ODS or CSV by the suffix; returns (item, delay, size) of what is in it.

    ``reading_hours`` are those besides meals (default: six a day), ``reliever`` is (name, delay, size, share taken), or () for none.
    """
    rows, true = example_rows(days, lang, seed, reading_hours, reliever)
    if path.lower().endswith(".ods"):
        from .sources.ods import document

        with open(path, "wb") as f:
            f.write(document(rows, item_name("diary", lang)))
    else:
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows(rows)
    return true


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = argparse.ArgumentParser(prog="lagloom", description=__doc__)
    p.add_argument("file", nargs="?")
    p.add_argument("sheet", nargs="?")
    p.add_argument("--format-help", action="store_true", help="describe the diary format")
    p.add_argument("--example", nargs="+", metavar=("FILE", "DAYS"), help="write a synthetic diary")
    p.add_argument("--validate", nargs="*", type=int, metavar="DAYS", help="detection quality on synthetic diaries")
    p.add_argument("--seeds", type=int, default=12, help="diaries for each line of --validate")
    p.add_argument("--replicates", type=int, help="resamplings (200; 120 for --validate)")
    p.add_argument("--lang", help="language of files and texts: en or fr (LAGLOOM_LANG, or the system's)")
    if not argv:
        p.print_help()
        return 1
    a = p.parse_args(argv)
    lang = language(a.lang)
    say = lambda code, **values: print(message(code, lang, **values), flush=True)
    if a.format_help:
        say("format")
        return 0
    if a.example:
        days = int(a.example[1]) if len(a.example) > 1 else 42
        true = write_example(a.example[0], days, lang)
        say("written", arg=a.example[0], n=days)
        for item, lag, size in true:
            say("culprit", arg=item, lag=lag, size=size)
        return 0
    spark = builder("local[*]").config("spark.sql.shuffle.partitions", os.cpu_count() or 8).getOrCreate()
    if a.validate is not None:
        from .plans.evaluate import evaluate
        from .plans.simulate import READING_HOURS

        for hours in ((), READING_HOURS):
            for days in a.validate or DURATIONS:
                m = evaluate(spark, a.seeds, days, hours, a.replicates or 120)
                say("quality", n=days, readings=m["n_obs"] or 0, recall=m["recall"] or 0, precision=m["precision"] or 0, err=float("nan") if m["err_lag_h"] is None else m["err_lag_h"])
        return 0
    from .plans.analyze import analyze
    from .plans.report import diagnostic, text
    from .sources.diary import load

    if not a.file:
        p.print_help()
        return 1
    obs, entries, relievers, diagnostics = load(spark, a.file, a.sheet, lang)
    for d in diagnostics.orderBy("line_no").collect():
        print(diagnostic(d, lang))
    readings, intakes = obs.count(), entries.count()
    if readings < 10 or intakes < 5:
        say("too_few", n=readings, arg=intakes)
        return 1
    results, stats, discarded = analyze(obs, entries, relievers, replicates=a.replicates or 200)
    print(text(results, stats, discarded, lang=lang))
    return 0


if __name__ == "__main__":
    sys.exit(main())
