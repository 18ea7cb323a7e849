"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_text import PLAIN, WORDS, lettered, tokenizer
from .common import Workspace, lean, partitions

#: Units whose ids a task keeps, and characters that a unit has then at most.
CACHE, KEPT_CHARS = 300_000, 64
#: Pieces of one length that are numbered in one task: at most, about, and at least where cores would be idle.
RANKED_TOGETHER, LEAST_TOGETHER = 20_000, 500


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open bins have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need that an open bin has; -1 if there is none."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    if not self.count[at]:
                        at += 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Returns runs (length, first, each, bin, offset): from the item ranked ``first`` of that length on,
    consecutive bins from ``bin`` on take ``each`` items, the first of a bin at ``offset``. Equal
    items and equal bins move together, so the work depends on the lengths, never on the counts.
    """
    tree, groups = CapacityTree(size), defaultdict(list)  # capacity -> [(first bin, bins)]
    runs, bins = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity:
            groups[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                each = size // length
                n = -(-left // each)
                capacity, first, bins = size, bins, bins + n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -n)
                each = capacity // length
            full = min(n, left // each)
            if full:
                runs.append((length, done, each, first, size - capacity))
                put(capacity - each * length, first, full)
                done, left = done + full * each, left - full * each
            if left and full < n:
                runs.append((length, done, each, first + full, size - capacity))
                put(capacity - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            if full < n:
                put(capacity, first + full, n - full)
    return runs


class _Ids(dict):
    """Ids of a pre-token as little-endian bytes."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        # a unit holds no blanks, so the byte alphabet leaves an ASCII one as it is
        ids = array("I", [t.id for t in self.model.tokenize(unit if unit.isascii() else lettered(unit))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(unit) <= KEPT_CHARS:
            self[unit] = out
        return out


_caches: dict[str, _Ids] = {}


def token_bytes(text: str, path: str) -> bytes:
    """All ids of a text, 4 little-endian bytes each, as the tokenizer file gives them."""
    if path not in _caches:
        _caches[path] = _Ids(tokenizer(path).model)
    if PLAIN(text) and "<|" not in text:
        return b"".join(map(_caches[path].__getitem__, WORDS(text.lower())))
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _cut(path: str, size: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = token_bytes(text or "", path) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _placed(runs: list[tuple[int, int, int, int, int]], columns: list[str]):
    by: dict[int, np.ndarray] = {}
    table = np.array(runs, np.int64).reshape(-1, 5)
    for length in np.unique(table[:, 0]):
        by[int(length)] = table[table[:, 0] == length][:, 1:]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(columns.index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                plan = by[int(n)]
                first, each, start, at = plan[np.searchsorted(plan[:, 0], rank[here], side="right") - 1].T
                sequence[here] = start + (rank[here] - first) // each
                offset[here] = at + (rank[here] - first) % each * n
            kept = [batch.column(i) for i, c in enumerate(columns) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(c for c in columns if c != "rank"), "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    size: int = 4096, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece of at most ``size`` tokens.

    A document is its ids and ``end_id``; only longer ones are cut. Best-fit decreasing runs on the
    histogram of piece lengths (``size`` rows at most), with a segment tree over remaining
    capacities; equal pieces are numbered across tasks (by hash buckets and prefix sums, so that a
    length which very many pieces share is no single task's) and each finds its bin by its number.

    Null and empty text: one piece, the end id. Null ids and repeated rows: a document each. An empty
    table gives an empty result; other columns are ignored. ``with_ids`` adds the ids as binary.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = base.mapInArrow(lean(_cut(tokenizer_path, size, end_id, with_ids)), schema)
    # the written number keeps pieces apart that are alike in all else
    pieces = ws.save((pieces if with_ids else pieces.drop("ids")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # one row for each length: ``size`` at most
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit(histogram, size)
    most = max(histogram.values(), default=0)
    buckets = max(1, -(-most // RANKED_TOGETHER), min(4 * partitions(spark), most // LEAST_TOGETHER))
    numbered = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    # ``size * buckets`` rows; a bucket is a fixed share of the most frequent length
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    own = [c for c in pieces.columns if c != "row"]
    columns = [*own, "rank"]
    ranked = ws.save(
        numbered.withColumn("n", F.row_number().over(order) - 1).join(starts, ["length", "bucket"])
        .select(*own, (F.col("n") + F.col("first")).cast("long").alias("rank")),
        "ranked",
    )
    ws.drop("pieces")
    out = [f"{c} {t}" for c, t in pieces.dtypes if c != "row"]
    return ranked.select(*columns).mapInArrow(lean(_placed(runs, columns)), ", ".join([*out, "sequence_id long", "offset long"]))
