"""The report of an analysis, as rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.i18n import message

LEAST, ROWS, ADVISED, NAMED = 0.15, 12, 3, 15


def top(results: DataFrame, diary_id: int | None = None) -> DataFrame:
    """The rows shown: up to 12 by frequency (ties by name), from 15 % on."""
    r = results if diary_id is None else results.where(F.col("diary_id") == diary_id)
    return r.where(F.col("frequency") >= LEAST).orderBy(F.desc("frequency"), "block").limit(ROWS)


def advice(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Up to three items to leave out next; never a reliever."""
    return results.where((F.col("sign") > 0) & (F.col("frequency") >= threshold)).orderBy(F.desc("frequency"), "block").limit(ADVISED)


def diagnostic(row, lang: str = "en") -> str:
    """A line of the diagnostics (line_no, code, arg) as text."""
    values = {"n": row["arg"]} if row["code"] == "default_time" else {"line": row["line_no"], "arg": row["arg"]}
    return message(row["code"], lang, **values)


def text(results: DataFrame, stats: DataFrame, discarded: DataFrame, diary_id: int = 0, threshold: float = 0.7, lang: str = "en") -> str:
    say = lambda code, **values: message(code, lang, **values)
    s = stats.where(F.col("diary_id") == diary_id).first()
    if s is None or s["error"]:
        return say("error", arg=say(s["error"] if s else "no_diary"))
    rows = top(results, diary_id).collect()
    out = [say("head", n=s["n_days"], readings=s["n_obs"], blocks=s["n_blocks"], rho=s["rho"]), ""]
    name, sure, delay, peak, effect, n = say("columns").split("|")
    out.append(f"{'':3}{name:28}{sure:>6}{delay:>8}{peak:>7}{effect:>8}{n:>5}")
    dash = lambda x, form: form.format(x) if x else "–"
    for r in rows:
        mark = ("◆" if r["selected"] else " ") + ("℞" if r["sign"] < 0 else " ")
        after = "–" if r["lag_h"] is None else f"{r['lag_h']:.1f} h"
        out.append(f"{mark:3}{r['block'][:27]:28}{r['frequency']:>6.0%}{after:>8}{dash(r['peak'], '{:+.1f}'):>7}{dash(r['effect'], '{:+.2f}'):>8}{r['occurrences']:>5}")
    out += ["", say("found", arg=f"{threshold:.0%}"), say("legend")]
    if any(r["sign"] < 0 for r in rows):
        out.append(say("reliever"))
    groups = results.where((F.col("diary_id") == diary_id) & F.col("block").contains("+")).orderBy("block").collect()
    if groups:
        out.append(say("together", arg=", ".join(r["block"].replace("+", " + ") for r in groups)))
    if s["undetectable"]:
        out.append(say("regular", arg=", ".join(s["undetectable"])))
    few = [r["item"] for r in discarded.where(F.col("diary_id") == diary_id).orderBy("item").limit(NAMED + 1).collect()]
    if few:
        out.append(say("rare", arg=", ".join(few[:NAMED]) + (" …" if len(few) > NAMED else "")))
    leave = [r["block"] for r in advice(results.where(F.col("diary_id") == diary_id), threshold).collect()]
    out.append(say("next", arg=", ".join(leave)) if leave else say("nothing"))
    return "\n".join(out)
