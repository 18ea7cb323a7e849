"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

#: Rows of a source, or of the whole order, that are numbered in one task: at most, about, and at least where cores would be idle.
RANKED_TOGETHER, LEAST_TOGETHER = 20_000, 500
_BITS = 60


def seeded_key(seed: int, id_col: str = "doc_id"):
    """A 60-bit number by which rows are shuffled: the first 15 digits of md5("seed:id:checksum:size").

    Checksum and size (columns text_crc32, size) keep rows that share an id, or have none, apart.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot): shards of equal row counts and equal mixture.

    Rows are ranked in seeded order within their source; a row's fractional rank is
    (rank + 1/2) / rows of its source. Sorted by that, the rows are cut into ``shards`` runs whose
    counts differ by one at most, so each shard has its share of every source to about one row.
    Both rankings are made by ranges: rows are counted by range, and numbered within it on top of the
    sums before, so a source with a third of all rows takes as many tasks as its rows need.

    size: UTF-8 bytes plus 1. Null text: empty. Null source: a source of its own. Null ids are
    shuffled as the text "null" with their texts. Ties are ordered by id, checksum and size; repeated rows get
    places of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "interleave")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = ws.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("part"),
        ).withColumn("h", seeded_key(seed)),
        "rows",
    )
    total = rows.count()
    bits = max(0, max(total // RANKED_TOGETHER, min(4 * partitions(spark), total // LEAST_TOGETHER)).bit_length())
    ranged = rows.withColumn("range", F.shiftright("h", _BITS - bits))
    ahead = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part", "range").agg(F.count("*").alias("n")).select(
        "part", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("part")).alias("of"),
    )
    ties = ["h", "doc_id", "text_crc32", "size"]
    number = F.row_number().over(Window.partitionBy("part", "range").orderBy(*ties)) - 1
    fraction = (2 * (F.col("first") + F.col("number")) + 1) / (2 * F.col("of"))
    ranked = ws.save(
        ranged.withColumn("number", number).join(starts, ["part", "range"])
        .withColumn("fraction", fraction.cast("double"))
        .select(*rows.columns, "fraction", F.floor(F.col("fraction") * (1 << bits)).alias("range")),
        "ranked",
    )
    # one row for each range of the whole order, total / RANKED_TOGETHER of them
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = ranked.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("fraction", "part", *ties)) - 1
    position = F.expr("first + number")
    shard = F.expr(f"cast((first + number) * {shards} div {max(1, total)} as int)")
    return (
        ranked.withColumn("number", place).join(cuts, "range")
        .select("doc_id", "size", "text_crc32", "source", shard.alias("shard"), position.alias("position"))
        .withColumn("slot", F.expr(f"position - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))
        .drop("position")
    )
