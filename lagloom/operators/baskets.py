"""Item counts, co-occurrence and the fusion of items that always come together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def item_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries per item; an item twice in an entry counts once."""
    return entries.groupBy(*by, "item").agg(F.countDistinct("entry_id").alias("n"))


def jaccard(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, together, jaccard) of items that share an entry, a < b.

    The self-join is on the entry, so its size follows the squared size of entries, not of the corpus.
    """
    e = entries.select(*by, "entry_id", "item").distinct()
    n = e.groupBy(*by, "item").agg(F.count("*").alias("n"))
    a, b = e.withColumnRenamed("item", "a"), e.withColumnRenamed("item", "b")
    pairs = a.join(b, [*by, "entry_id"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("together"))
    return (
        pairs.join(n.withColumnsRenamed({"item": "a", "n": "na"}), [*by, "a"])
        .join(n.withColumnsRenamed({"item": "b", "n": "nb"}), [*by, "b"])
        .select(*by, "a", "b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("jaccard"))
    )


def components(items: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, item, root): the least item reachable over ``pairs(a, b)``.

    Every item takes the least name among its root's neighbours, then the root of that root, until nothing changes;
    what changes halves the length of chains, so rounds follow the logarithm of the longest. All is done by joins
    on (by, item): no group meets in one task, and only a count comes to the driver.
    """
    key = [*by, "item"]
    labels = items.select(*key).distinct().withColumn("root", F.col("item"))
    found = pairs.select(*by, "a", "b").where("a <> b")
    edges = cut(found.unionByName(found.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        of = labels.select(*by, F.col("item").alias("b"), F.col("root").alias("near"))
        least = edges.join(of, [*by, "b"]).groupBy(*by, F.col("a").alias("item")).agg(F.min("near").alias("near"))
        hooked = labels.join(least, key, "left").withColumn("least", F.least("root", F.coalesce("near", "root")))
        # the root itself follows its members, and all take the root's root
        moved = hooked.groupBy(*by, F.col("root").alias("item")).agg(F.min("least").alias("to"))
        stepped = hooked.select(*key, "root", "least").join(moved, key, "left").select(*key, "root", F.least("least", F.coalesce("to", "least")).alias("next"))
        jump = stepped.select(*by, F.col("item").alias("next"), F.col("next").alias("last"))
        after = cut(stepped.join(jump, [*by, "next"], "left").select(*key, F.col("root").alias("before"), F.least("next", F.coalesce("last", "next")).alias("root")))
        labels = after.select(*key, "root")
        if after.where("before <> root").isEmpty():
            return labels


def grouped_components(items: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """:func:`components` in one lazy plan, by union-find per group, for many groups of few items (diaries).

    Pairs are first thinned by (group, hash): a task keeps a spanning forest of its share, so what meets for a
    group follows its items, not its pairs.
    """

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(pdf["a"], pdf["b"]):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
        out = pd.DataFrame({"item": list(parent), "root": [root(x) for x in list(parent)]})
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    def thinned(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        keep = []
        for a, b in zip(pdf["a"], pdf["b"]):
            if (p := root(a)) != (q := root(b)):
                parent[max(p, q)] = min(p, q)
                keep.append(True)
            else:
                keep.append(False)
        return pdf.loc[keep, [*by, "a", "b"]]

    key = [*by, "item"]
    all_items = items.select(*key).distinct()
    kinds = dict(all_items.dtypes)
    few = pairs.select(*by, "a", "b", F.pmod(F.xxhash64("a"), F.lit(16)).alias("share"))
    forest = few.groupBy(*by, "share").applyInPandas(thinned, ", ".join([*(f"{c} {kinds[c]}" for c in by), "a string, b string"]))
    found = forest.groupBy(*by).applyInPandas(
        united, ", ".join([*(f"{c} {kinds[c]}" for c in by), "item string, root string"])
    )
    return all_items.join(found, key, "left").select(*key, F.coalesce("root", "item").alias("root"))


def blocks(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, item, block): members of a component joined by +, in order."""
    names = labels.groupBy(*by, "root").agg(F.array_join(F.array_sort(F.collect_list("item")), "+").alias("block"))
    return labels.join(names, [*by, "root"]).select(*by, "item", "block")


def fuse(entries: DataFrame, by: list[str], threshold: float = 0.85, grouped: bool = True) -> DataFrame:
    """Items with a Jaccard index of at least ``threshold``, transitively, as blocks.

    ``grouped`` suits many diaries with vocabularies of their own; without it, any vocabulary.
    """
    pairs = jaccard(entries, by).where(F.col("jaccard") >= threshold)
    return blocks((grouped_components if grouped else components)(entries, pairs, by), by)


def block_events(entries: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Entries by block: a block with several members in an entry is there once."""
    return entries.join(members, [*by, "item"]).select(*by, "entry_id", "t_h", "block").distinct()
