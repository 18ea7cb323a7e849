"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, finite_vector, lean
from .minhash import blocks_of

SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
BLOCK = 1024
#: Share of pairs at the threshold that the tables have to bring together, by measurement on the sample.
RECALL = 0.995
MOST_TABLES = 256
#: Links that a task lists at once.
LINKS = 1 << 16
#: Dimensions of a table at most: more are an error.
MOST_DIMENSIONS = 10_000


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """ITQ: alternates between binary codes of the rotated vectors and the rotation that fits them best."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


class Codes:
    """Rotations and the substrings that key the tables."""

    def __init__(self, mean: np.ndarray, rotations: list[np.ndarray], width: int, tables: int):
        self.mean, self.rotation = mean, np.concatenate(rotations, axis=1)
        self.width, self.tables = width, tables

    @classmethod
    def whole(cls, dim: int) -> "Codes":
        """One bucket of all vectors."""
        return cls(np.zeros(dim), [np.zeros((dim, 1))], 0, 1)

    @property
    def places(self) -> np.ndarray:
        return np.arange(self.width * self.tables).reshape(self.tables, self.width)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Substring of each table (n, tables), as integers."""
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        bits = ((unit - self.mean) @ self.rotation >= 0).astype(np.int64)
        return bits[:, self.places] @ (1 << np.arange(self.width, dtype=np.int64))

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, cosine: float, seed: int) -> "Codes":
        """Width by the number of rows; tables until RECALL of partners at ``cosine`` share a key.

        Where MOST_TABLES don't suffice, the width shrinks until they do. Width 0 is one bucket of all rows.
        """
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        mean = unit.mean(axis=0)
        width = min(40, max(4, math.ceil(math.log2(max(2, rows))) + 1))
        noise = np.random.default_rng(seed).standard_normal(unit.shape)
        noise -= (noise * unit).sum(axis=1)[:, None] * unit
        length = np.linalg.norm(noise, axis=1)[:, None]
        partner = cosine * unit + math.sqrt(1 - cosine * cosine) * noise / np.where(length > 0, length, 1)
        rotations: list[np.ndarray] = []
        while True:
            missed, table, used = np.ones(len(unit), bool), 0, 0
            equal = np.empty((len(unit), 0), bool)
            while table < MOST_TABLES and missed.mean() > 1 - RECALL:
                while equal.shape[1] < width:
                    if used == len(rotations):
                        rotations.append(learn_rotation(unit - mean, seed + used))
                    r, used = rotations[used], used + 1
                    equal = np.concatenate([equal, ((unit - mean) @ r >= 0) == ((partner - mean) @ r >= 0)], axis=1)
                missed &= ~equal[:, :width].all(axis=1)
                equal, table = equal[:, width:], table + 1
            if missed.mean() <= 1 - RECALL:
                break
            width -= 1
        rotations = rotations[: max(1, used)]
        return cls(mean, rotations, width, table)


def _coded(codes, key_type: str):
    """Adds the keys of each row (rid, vec, copies), by the codes of its dimension."""

    def run(batches):
        import pyarrow as pa

        kind = getattr(pa, key_type)()
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                n, code = len(part), codes.value[dim]
                keys = code.keys(part.column(1).flatten().to_numpy().reshape(n, -1).astype(np.float64))
                ends = pa.array(np.arange(0, n * code.tables + 1, code.tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()).cast(kind))], ["rid", "vec", "copies", "keys"])

    return run


def _linked(cosine: float):
    """Degrees and a spanning set of edges from each pair of blocks of a bucket, in order of its key."""

    def pairs(table, rows):
        ids, side, copies, x, keys = (np.concatenate(c) for c in zip(*rows))
        x = x / np.linalg.norm(x, axis=1)[:, None]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        degree, label, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        whole = bool((side == 2).all())
        # a slice holds LINKS pairs at most, so that a group of vectors that are all near takes little memory
        step = max(1, min(256, LINKS // max(1, len(right))))
        for s in range(0, len(left), step):
            rows_ = left[s : s + step]
            a, b = np.nonzero(x[rows_] @ x[right].T >= cosine)
            a, b = rows_[a], right[b]
            near = (ids[a] < ids[b]) if whole else ids[a] != ids[b]
            a, b = a[near], b[near]
            if table:  # a pair counts in the first table that brings it together
                first = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
                a, b = a[first], b[first]
            degree += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
            degree += np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
            while len(a):
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                if len(a):
                    edges.append((int(ids[a[0]]), 0, int(ids[b[0]])))
                    label[label == label[b[0]]] = label[a[0]]
        return [(int(i), int(d), None) for i, d in zip(ids, degree) if d] + edges

    def run(batches):
        import pyarrow as pa

        def made(key, rows):
            if found := pairs(key[1], rows):
                cols = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "degree", "other"])

        now, rows = None, []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if now is not None and tuple(key[start].tolist()) != now:
                    yield from made(now, rows)
                    rows = []
                now = tuple(key[start].tolist())
                part = batch.slice(start, end - start)
                n = end - start
                ids, side, copies = (part.column(i).to_numpy() for i in (5, 6, 7))
                x, keys = (part.column(i).flatten().to_numpy().reshape(n, -1) for i in (8, 9))
                rows.append([ids, side, copies, x.astype(np.float64), keys])
        if rows:
            yield from made(now, rows)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row, by cosine in double precision.

    Equal vectors form one class; only its smallest id goes on, and counts as many as it stands for.
    Rotations for balanced binary codes are learned by iterative quantisation on a bounded sample
    (``SAMPLE_ROWS`` vectors with the smallest hash of their id, ``SAMPLE_VALUES`` numbers at most);
    all vectors are coded. Substrings of the codes key Hamming tables; their width follows the
    number of vectors, and there are as many as bring together RECALL of pairs at the threshold, as
    measured on the sample; the width is narrowed where MOST_TABLES of that width don't reach it, so
    that buckets grow and no links are given up. Within a bucket all pairs are reranked by their vectors, large buckets
    in pairs of blocks; a pair counts in the first table that has it. Tasks return degrees and a
    spanning set of links, never the pairs of a group.

    Vectors are compared within their dimension, each dimension by rotations and tables of its own; those of a dimension
    that has ``BLOCK`` classes at most are all compared. Over ``MOST_DIMENSIONS`` dimensions are an error.

    Null vectors, zero vectors, vectors with null or non-finite components, and null ids link with
    nothing: n_links 0, component_id their own id, kept (null id: component_id null, kept). Vectors
    of unlike dimension are not linked. Rows that repeat an id are vectors of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "near-vectors")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = F.col("vec_id").isNotNull() & finite_vector(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    marked = base.select(
        "vec_id", "vec", F.coalesce(good, F.lit(False)).alias("good"),
        F.xxhash64("vec").alias("ha"), F.xxhash64(F.lit(1), "vec").alias("hb"),
    )
    usable = marked.where("good")
    classes = ws.save(usable.groupBy("ha", "hb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = usable.join(classes.withColumnsRenamed({"ha": "ca", "hb": "cb"}), F.expr("vec_id = rep and ha = ca and hb = cb")).select("rep", "vec", "copies", "ha", "hb")
    # the written number is a class's own, also where ids repeat
    reps = ws.save(reps.dropDuplicates(["ha", "hb"]).withColumn("rid", F.monotonically_increasing_id()), "reps")
    dims = {r["dim"]: r["n"] for r in reps.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).limit(MOST_DIMENSIONS + 1).collect()}
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of over {MOST_DIMENSIONS} dimensions")
    if not dims:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = {}
    for dim, n in dims.items():
        if n <= BLOCK:
            codes[dim] = Codes.whole(dim)
            continue
        take = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
        sample = reps.where(F.size("vec") == dim).select("rep", "vec", F.xxhash64("rep").alias("h")).orderBy("h", "rep").limit(take).select("vec").toArrow()["vec"]
        codes[dim] = Codes.fit(np.array(sample.combine_chunks().flatten(), np.float64).reshape(-1, dim), n, cosine, seed)
    kind = dict(reps.dtypes)["vec"]
    key_type = ("int32", "int") if max(c.width for c in codes.values()) < 32 else ("int64", "long")
    coded = ws.save(
        reps.select("rid", "vec", "copies").mapInArrow(lean(_coded(spark.sparkContext.broadcast(codes), key_type[0])), f"rid long, vec {kind}, copies long, keys array<{key_type[1]}>"),
        "coded",
    )
    entries = coded.select("rid", F.size("vec").alias("dim"), F.posexplode("keys").alias("t", "key"))
    crowded = entries.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    places = entries.join(crowded, ["dim", "t", "key"]).groupBy("rid").agg(F.collect_list(F.struct("t", "key", "n")).alias("places"))
    order = ["dim", "t", "key", "bi", "bj"]
    found = ws.save(
        coded.join(places, "rid").withColumn("p", F.explode("places")).withColumn("hashed", F.xxhash64("rid"))
        .select("rid", "copies", "vec", "keys", "hashed", F.size("vec").alias("dim"), F.col("p.t").alias("t"), F.col("p.key").alias("key"), F.col("p.n").alias("n"))
        .withColumn("block", F.explode(blocks_of("n", "hashed", BLOCK)))
        .select("dim", "t", "key", "block.bi", "block.bj", "rid", "block.side", "copies", "vec", "keys")
        .repartition(*order).sortWithinPartitions(*order, "rid")
        .mapInArrow(lean(_linked(cosine)), "rid long, degree long, other long"),
        "found",
    )
    degrees = found.where("other is null").groupBy("rid").agg(F.sum("degree").alias("degree"))
    parts = connected_components(ws, found.where("other is not null").select(F.col("rid").alias("src"), F.col("other").alias("dst")))
    named = reps.select("rid", "rep", "ha", "hb", "copies").join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = ws.save(named.join(least, "component").join(degrees, "rid", "left").select("ha", "hb", "copies", "degree", "component_id"), "known")
    ws.drop("reps", "coded")
    placed = marked.select("vec_id", F.when(F.col("good"), F.col("ha")).alias("ha"), F.col("hb")).join(known, ["ha", "hb"], "left")
    own = F.coalesce("component_id", "vec_id")
    return placed.select(
        "vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("degree", F.lit(0))).cast("long").alias("n_links"),
        own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )
