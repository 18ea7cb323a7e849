"""Chat formatting: multi-party perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Turns of a dialogue that one row holds; the rendering of a longer one is cut, without any change, into rows.
TURNS_PER_ROW = 16_384
#: Dialogues longer than that, of which a table is broadcast; more of them are joined.
MOST_SENT = 200_000
END = "<|end|>\n"


def escaped_text(c: Column) -> Column:
    r"""A text in which no ``<|`` is left, so that it cannot forge a mark: ``<|`` is written ``<\|``, and ``<\`` is ``<\\``.

    Taking one backslash from each ``<\|`` and ``<\\`` gives the text back.
    """
    return F.regexp_replace(c, r"<([|\\])", r"<\\$1")


def escaped_name(c: Column) -> Column:
    r"""A name in which neither ``<|`` nor ``|>`` is left, in the same way."""
    return F.regexp_replace(escaped_text(c), r"\|([>\\])", r"|\\$1")


def _rendered(each: DataFrame, system_roles: tuple[str, ...]) -> DataFrame:
    """(conv_id, perspective, start, n_turns, rendered, loss_mask, loss_spans) of rows with ``messages`` and a perspective."""
    system = F.array(*(F.lit(r) for r in system_roles)).cast("array<string>")
    own = lambda m: m["role"] == F.col("perspective")
    head = lambda m: F.when(own(m), F.lit("<|assistant|>\n")).otherwise(m["head"])
    heads = lambda m: (
        F.when(F.array_contains(system, m["role"]), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped_name(m["role"]), F.lit("|>\n")))
    )
    lines = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), heads(m).alias("head"), F.concat(escaped_text(m["text"]), F.lit(END)).alias("body")))
    span = lambda at, m: F.struct((at + F.length(head(m))).cast("long").alias("start"), (at + F.length(head(m)) + F.length(m["body"])).cast("long").alias("end"))
    kind = "array<struct<start:long,end:long>>"
    spans = F.aggregate(
        "lines",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans")),
        lambda a, m: F.struct(
            (a["at"] + F.length(head(m)) + F.length(m["body"])).cast("long").alias("at"),
            F.when(own(m), F.concat(a["spans"], F.array(span(a["at"], m)))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return each.withColumn("lines", lines).select(
        "conv_id", "perspective", "start", F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", lambda m: F.concat(head(m), m["body"])), "").alias("rendered"),
        F.array_join(F.transform("lines", lambda m: F.when(own(m), F.lit("1")).otherwise(F.lit("0"))), "").alias("loss_mask"),
        spans.alias("loss_spans"),
    )


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", system_roles: tuple[str, ...] = ("system",), turns_per_row: int = TURNS_PER_ROW,
) -> DataFrame:
    """(conv_id, perspective, start, n_turns, rendered, loss_mask, loss_spans) per participant: the whole dialogue.

    Every speaker that is not a system role is once the assistant; the others become users with
    their names, system turns stay system turns. ``loss_mask`` has a 1 for each turn of the
    perspective's speaker and a 0 for others; ``loss_spans`` has [start, end) in code points of
    the rendering for each 1: the turn's text and its end mark. Texts and names are escaped (:func:`escaped_text`),
    so that none can forge a mark.

    A dialogue of up to ``turns_per_row`` turns is one row, with ``start`` 0. The rendering of a longer one, the same
    text, is cut into rows of about as many turns (equal ranges of turn numbers), so that no task gathers an unbounded dialogue:
    ``start`` is the number of turns before the row, and masks and texts by rising ``start`` join to the whole, whose
    places ``loss_spans`` gives.

    Null text: empty. Null role: a speaker named "unknown". Null turn: before all others.
    Null conversation ids: one conversation. Ties of a turn are ordered by role, then text; repeated
    rows are rendered each time. A conversation of system turns alone has no participant and no
    rows. An empty table gives an empty result; other columns are ignored.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    speaks = lambda role: ~role.isin(*system_roles) if system_roles else F.lit(True)
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    speakers = F.filter(F.array_distinct(F.transform("messages", lambda m: m["role"])), speaks)
    whole = lambda some: _rendered(
        some.groupBy("conv_id").agg(messages).select("conv_id", F.lit(0).cast("long").alias("start"), "messages", F.explode(speakers).alias("perspective")), system_roles
    )
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("of"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).where(F.col("of") > turns_per_row)
    ws = Workspace(spark, "chat")
    long_ = ws.save(sizes.withColumnRenamed("conv_id", "long_id"), "long")
    found = long_.count()
    if not found:
        return whole(rows)
    # one row for each dialogue of over ``turns_per_row`` turns
    table = F.broadcast(long_) if found <= MOST_SENT else long_
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    wide = (F.col("hi") - F.col("lo") + 1).cast("double")
    part = F.coalesce(F.floor((F.col("turn") - F.col("lo")) * F.ceil(F.col("of") / turns_per_row) / wide), F.lit(-1)).cast("long")
    cut = rows.join(table, same).withColumn("part", part)
    parts = cut.groupBy("conv_id", "part").agg(messages)
    people = cut.where(speaks(F.col("role"))).select(F.col("conv_id").alias("of_id"), F.col("role").alias("perspective")).distinct()
    pieces = parts.withColumn("start", F.col("part")).join(people, F.col("conv_id").eqNullSafe(F.col("of_id")))
    pieces = ws.save(_rendered(pieces, system_roles).withColumnRenamed("start", "part"), "pieces")
    order = "PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    before = pieces.select(
        F.col("conv_id").alias("of_id"), F.col("perspective").alias("of_perspective"), F.col("part").alias("of_part"),
        F.expr(f"coalesce(sum(n_turns) OVER ({order}), 0L)").alias("start"), F.expr(f"coalesce(sum(length(rendered)) OVER ({order}), 0L)").alias("ahead"),
    )
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + F.col("ahead")).alias("start"), (s["end"] + F.col("ahead")).alias("end")))
    joined = pieces.join(before, F.expr("conv_id <=> of_id and perspective = of_perspective and part = of_part"))
    cut_up = joined.select("conv_id", "perspective", "start", "n_turns", "rendered", "loss_mask", moved.alias("loss_spans"))
    return whole(rows.join(table, same, "left_anti")).unionByName(cut_up)
