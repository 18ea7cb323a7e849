"""Line dedup: sharded minimal perfect hash over the hashes of distinct lines."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, mix64, partitions, texts_as_bytes

#: What counts as white space at a line's ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Keys of a shard, and lines that one task probes with, at most, about; at least, where all cores have work.
KEYS_PER_SHARD, LINES_PER_TASK = 200_000, 1_000_000
LEAST_KEYS, LEAST_LINES = 2_000, 5_000
#: Shards with many lines of which a table is broadcast; more are joined.
MOST_SENT = 1_000_000


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped, A-Z lower-cased; None if it has under ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


class PerfectHash:
    """Minimal perfect hash in levels: a key that is alone on its slot takes it, others go deeper."""

    SPARE = 2.0

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]

    @staticmethod
    def slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (mix64(hi + lo * turn + turn) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> "PerfectHash":
        sizes, taken, start = [], [], 0
        while len(hi):
            size = -(-max(64, int(len(hi) * cls.SPARE)) // 64) * 64
            at = cls.slot(hi, lo, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken.append(start + at[alone])
            sizes.append(size)
            start += size
            hi, lo = hi[~alone], lo[~alone]
        flags = np.zeros(start, dtype=np.uint8)
        if taken:
            flags[np.concatenate(taken)] = 1
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little").view(np.uint64))

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or any index for keys that are not in the set."""
        out, start = np.full(len(hi), -1, np.int64), 0
        left = np.arange(len(hi))
        for level, size in enumerate(self.sizes):
            at = start + self.slot(hi[left], lo[left], level, int(size))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below)
            out[left[hit]] = rank[hit]
            left = left[~hit]
            start += int(size)
            if not len(left):
                break
        return out


def _lines(least: int):
    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            ids, his, los = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                seen = set()
                for line in text.split(b"\n"):
                    key = line_key(line, least)
                    if key is not None:
                        seen.add(xxhash.xxh3_128_digest(key))
                ids += [doc] * len(seen)
                his += seen
            both = np.frombuffer(b"".join(his), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())],
                ["hi", "lo", "doc_id"],
            )

    return keys


def prints(lo: np.ndarray) -> np.ndarray:
    return lo.view(np.uint64).astype(np.uint32)


def _index(batches):
    import pyarrow as pa

    def built(shard, rows):
        hi, lo, n, owner = (np.concatenate(x) for x in zip(*rows))
        mph = PerfectHash.build(hi.view(np.uint64), lo.view(np.uint64))
        at = mph.find(hi.view(np.uint64), lo.view(np.uint64))
        arrays = []
        for x in (prints(lo), np.minimum(n, 2**32 - 1).astype(np.uint32), owner):
            y = np.empty_like(x)
            y[at] = x
            arrays.append(y.tobytes())
        row = [shard, mph.sizes.tobytes(), mph.bits.tobytes(), *arrays, int(n.sum())]
        names = ["shard", "sizes", "bits", "prints", "counts", "owners", "load"]
        return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=_index_arrow())

    now, rows = None, []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cols = [batch.column(i).to_numpy() for i in range(1, 5)]
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(shards)]):
            if start == end:
                continue
            if now is not None and shards[start] != now:
                yield built(now, rows)
                rows = []
            now = int(shards[start])
            rows.append([c[start:end] for c in cols])
    if rows:
        yield built(now, rows)


_INDEX = "shard long, sizes binary, bits binary, prints binary, counts binary, owners binary, load long"


def _index_arrow():
    import pyarrow as pa

    return pa.schema(
        [("shard", pa.int64()), *((x, pa.binary()) for x in ("sizes", "bits", "prints", "counts", "owners")), ("load", pa.int64())]
    )


def _probe(batches):
    import pyarrow as pa

    mph = held = counts = owners = None
    now = None
    for batch in batches:
        routes, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(routes) != 0) | (np.diff(roles) != 0)) + 1), len(routes)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if roles[start] == 0:
                row = {k: v[0] for k, v in batch.slice(start, 1).to_pydict().items()}
                mph = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64))
                held, counts, owners = (np.frombuffer(row[x], t) for x, t in (("prints", np.uint32), ("counts", np.uint32), ("owners", np.int64)))
                now = int(routes[start])
                continue
            if now != int(routes[start]):
                continue
            part = batch.slice(start, end - start)
            hi, lo, doc = (part.column(i).to_numpy() for i in (2, 3, 4))
            at = mph.find(hi.view(np.uint64), lo.view(np.uint64))
            drop = (at >= 0) & (held[at] == prints(lo))
            drop &= (counts[at] > 1) & (owners[at] != doc)
            if drop.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[drop]), pa.array(hi[drop]), pa.array(lo[drop])], ["doc_id", "hi", "lo"]
                )


def _apply(least: int):
    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            his, los = batch.column(2), batch.column(3)
            lines, dropped, texts = [], [], []
            for text, hi, lo in zip(texts_as_bytes(batch.column(1)), his, los):
                if not hi.is_valid:
                    lines.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    texts.append(text)
                    continue
                gone = set(zip(hi.as_py(), lo.as_py()))
                all_lines, stay = text.split(b"\n"), []
                for line in all_lines:
                    key = line_key(line, least)
                    if key is None or tuple(np.frombuffer(xxhash.xxh3_128_digest(key), np.int64).tolist()) not in gone:
                        stay.append(line)
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
                texts.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *batch.columns[4:]],
                ["doc_id", "n_lines", "n_dropped", "kept_text", *batch.schema.names[4:]],
            )

    return kept


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that an earlier document holds: (doc_id, n_lines, n_dropped, kept_text, *carry) per row.

    A line's key (white space stripped, A-Z lower-cased, ``min_chars`` code points at least) that
    two documents hold stays in the smallest id only. All distinct keys go, by hash, into
    shards; each shard is a minimal perfect hash that points into arrays of 32-bit fingerprints,
    document counts and owners. Distinct line hashes of the documents are sent to their shard and
    probe its arrays, whose counts decide; a shard whose lines are many (a hot line) is copied to more tasks in
    proportion to its load, so that no task probes with much over ``LINES_PER_TASK`` lines.

    Null or empty text: one empty line, kept_text empty. Null ids: the row is returned as it is and
    owns no line. Rows that share an id are one document: they never drop each other's lines.
    Lines repeated within one document stay. An empty table gives an empty result; other columns
    of any name are ignored, but for those in ``carry``, which are returned under their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "line-dedup")
    own = [f"own{i}" for i in range(len(carry))]
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(o) for c, o in zip(carry, own)),
    )
    named = base.where("doc_id is not null")
    lines = ws.save(named.select("doc_id", "text").mapInArrow(lean(_lines(min_chars)), "hi long, lo long, doc_id long"), "lines")
    distinct = ws.save(lines.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")), "keys")
    # sizes follow the data; only where that would leave cores idle, shards and tasks are smaller
    n_keys, n_lines, spread = distinct.count(), lines.count(), 4 * partitions(spark)
    n_shards = max(1, -(-n_keys // KEYS_PER_SHARD), min(spread, n_keys // LEAST_KEYS))
    each_task = min(LINES_PER_TASK, max(LEAST_LINES, n_lines // spread))
    shard = F.pmod(F.xxhash64("hi"), F.lit(n_shards))
    index = ws.save(
        distinct.select(shard.alias("shard"), "hi", "lo", "n", "owner")
        .repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_index), _INDEX),
        "index",
    )
    # one row for each task beyond a shard's first
    crowded = index.select("shard", F.ceil(F.col("load") / each_task).cast("int").alias("copies")).where("copies > 1")
    crowded = F.broadcast(crowded) if crowded.count() <= MOST_SENT else crowded
    copies = F.coalesce("copies", F.lit(1))
    route = lambda copy: F.col("shard") * (1 << 24) + copy
    asked = lines.withColumn("shard", shard).join(crowded, "shard", "left").select(
        route(F.pmod(F.xxhash64("doc_id"), copies)).alias("route"),
        F.lit(1).alias("role"), "hi", "lo", "doc_id",
        *(F.lit(None).cast("binary").alias(x) for x in ("sizes", "bits", "prints", "counts", "owners")),
    )
    each = F.explode(F.sequence(F.lit(0), copies - 1))
    held = index.join(crowded, "shard", "left").withColumn("copy", each).select(
        route(F.col("copy")).alias("route"),
        F.lit(0).alias("role"),
        *(F.lit(None).cast("long").alias(x) for x in ("hi", "lo", "doc_id")),
        "sizes", "bits", "prints", "counts", "owners",
    )
    drops = (
        held.unionByName(asked)
        .repartition("route").sortWithinPartitions("route", "role")
        .mapInArrow(lean(_probe), "doc_id long, hi long, lo long")
        .groupBy("doc_id").agg(F.collect_list("hi").alias("his"), F.collect_list("lo").alias("los"))
    )
    none = F.lit(None).cast("array<long>")
    joined = named.join(drops.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "his", "los", *own)
    unnamed = base.where("doc_id is null").select("doc_id", "text", none.alias("his"), none.alias("los"), *own)
    kinds = dict(base.dtypes)
    out = ["doc_id long, n_lines long, n_dropped long, kept_text string", *(f"{o} {kinds[o]}" for o in own)]
    return joined.unionByName(unnamed).mapInArrow(lean(_apply(min_chars)), ", ".join(out)).select(
        "doc_id", "n_lines", "n_dropped", "kept_text", *(F.col(o).alias(c) for c, o in zip(carry, own))
    )
