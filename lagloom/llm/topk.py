"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, finite_vector, lean, partitions

#: Vectors whose lengths are within this factor share a bucket.
STEP = 1.05
#: Rows of a bucket: at most, about, and at least where cores would be idle.
BUCKET_ROWS, LEAST_ROWS = 4096, 256
QUERY_BLOCK = 16_384
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.5
#: Largest coordinates of a query that prune a bucket.
COORDINATES = 3
#: The longest vectors, whose products give each query its first threshold; numbers that they hold at most.
SEEDS, SEED_VALUES = 2048, 1 << 20
#: Classes of length of which a table is broadcast; more are joined.
MOST_CLASSES = 100_000
#: Products and partial sums under this are exact in doubles.
EXACT = 2.0**53


def _dot(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where no sum can pass 2**53, else Python integers."""
    if not len(m):
        return np.empty(0)
    if float(np.abs(m).max()) * float(np.abs(q).max()) * m.shape[1] < EXACT:
        return m @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in m], dtype=object)


class _Bucket:
    def __init__(self, uids: np.ndarray, ids: np.ndarray, vecs: np.ndarray):
        norms = np.sqrt((vecs * vecs).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.uids, self.ids, self.vecs, self.norms = uids[order], ids[order], vecs[order], norms[order]
        self.unit = self.vecs / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by:
            at = np.argsort(self.unit[:, f], kind="stable")
            self.by[f] = at, self.unit[at, f]
        return self.by[f]

    def candidates(self, q: np.ndarray, length: float, floor: float) -> np.ndarray | slice:
        """Rows whose product with q can reach ``floor``."""
        if not np.isfinite(floor) or length == 0 or floor <= 0:
            return slice(None)
        eps = 1e-9
        cosine = floor / (length * self.norms[0]) if self.norms[0] > 0 else np.inf
        if cosine > 1 + eps:
            return slice(0)
        if cosine < COORDINATE_FROM:
            return slice(int(np.searchsorted(-self.norms, -(floor / length) * (1 - eps), side="right")))
        found = None
        for f in np.argsort(-np.abs(q), kind="stable")[:COORDINATES].tolist():
            x = q[f] / length
            spread = np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - x * x))
            lo, hi = x * cosine - spread, x * cosine + spread
            # beyond these the bound turns round: cosines over the threshold lie nearer to q
            lo, hi = (-1.0 if x <= -cosine else lo), (1.0 if x >= cosine else hi)
            if found is None:
                at, values = self.coordinate(f)
                found = at[np.searchsorted(values, lo - eps) : np.searchsorted(values, hi + eps, side="right")]
            else:
                values = self.unit[found, f]
                found = found[(values >= lo - eps) & (values <= hi + eps)]
        return found


def _seeded(k: int, seeds):
    """Adds to queries (uid, vec_id, vec, dim) the k-th largest product with ``seeds``: no smaller one is among the results."""

    def run(batches):
        import pyarrow as pa

        uids, vecs = seeds.value
        for batch in batches:
            floors = np.full(len(batch), -np.inf)
            dims = batch.column(3).to_numpy()
            here = np.flatnonzero(dims == vecs.shape[1])
            if len(here) and len(uids) > k:
                x = batch.column(2).take(pa.array(here)).flatten().to_numpy().reshape(len(here), -1)
                if float(np.abs(x).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * vecs.shape[1] < EXACT:
                    for s in range(0, len(here), 512):
                        products = x[s : s + 512] @ vecs.T
                        products[batch.column(0).to_numpy()[here[s : s + 512]][:, None] == uids[None, :]] = -np.inf
                        floors[here[s : s + 512]] = np.partition(products, len(uids) - k, axis=1)[:, len(uids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], [*batch.schema.names, "floor"])

    return run


def _search(k: int):
    """Reads (block, slice, role, bucket, dim, uid, vec_id, floor, vec) in order: a block of queries, then buckets, longest first."""

    def merged(best, ids, scores):
        """The k best of two lists, by score, then id."""
        ids, scores = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def against(queries, bucket):
        for q in queries:
            vec, length = q["vec"], q["length"]
            if len(vec) != bucket.vecs.shape[1]:
                continue
            ids, scores = q["best"]
            floor = max(q["floor"], float(scores[-1])) if len(ids) >= k else q["floor"]
            at = bucket.candidates(vec, length, floor)
            s, i = _dot(bucket.vecs[at], vec), bucket.ids[at]
            near = (s >= floor) & (bucket.uids[at] != q["uid"]) if len(s) else np.zeros(0, bool)
            s, i = s[near], i[near]
            if len(s) > 4 * k and s.dtype != object:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, i = s[keep], i[keep]
            if len(s):
                q["best"] = merged(q["best"], i, s)

    def run(batches):
        import pyarrow as pa

        def out(queries):
            rows = [(q["uid"], q["id"], int(i), max(-(1 << 63), min((1 << 63) - 1, int(s)))) for q in queries for i, s in zip(*q["best"])]
            for start in range(0, len(rows), 50_000):
                columns = zip(*rows[start : start + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["uid", "query_id", "vec_id", "score"])

        now, queries, bucket, held = None, [], None, []

        def flush():
            if held and queries:
                against(queries, _Bucket(*(np.concatenate(x) for x in zip(*held))))
            held.clear()

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            uids, ids, floors, vecs = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7)), batch.column(8))
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                block, part, role, _, dim = key[start].tolist()
                if now != (block, part):
                    flush()
                    yield from out(queries)
                    now, queries = (block, part), []
                flat = vecs.slice(start, end - start).flatten().to_numpy()
                rows = flat.reshape(end - start, dim).astype(np.float64)
                if role == 0:
                    queries += [
                        {"uid": int(u), "id": int(i), "floor": float(x), "vec": v, "length": float(np.sqrt(v @ v)), "best": (np.empty(0, np.int64), np.empty(0))}
                        for u, i, x, v in zip(uids[start:end], ids[start:end], floors[start:end], rows)
                    ]
                    continue
                if bucket != tuple(key[start]):
                    flush()
                    bucket = tuple(key[start])
                held.append((uids[start:end], ids[start:end], rows))
        flush()
        yield from out(queries)

    return run


def top_products(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row that ``queries`` holds for.

    ``vec_col`` holds whole numbers (as doubles or longs), ``queries`` is a condition on ``id_col``
    (named ``vec_id`` in it). Vectors are grouped into buckets of like length, at most about 4096
    rows each (a length that very many share is salted). Products with a bounded number of the longest vectors give
    each query a first threshold. A task takes a block of queries through
    buckets from the longest to the shortest and keeps each query's k best so far; the k-th product
    gives a bucket's local cosine threshold, by which the bucket is skipped, cut by length, or cut
    by the bounds of the query's largest coordinates. Products of what is left are exact; they saturate at the limits of a long.

    Ties go to the smaller id. Fewer than k rows: all. A query never gets its own row; rows that repeat an id are
    queries and candidates each. Null vectors, vectors with null or non-finite components, empty ones and null ids take
    no part; vectors of another dimension are no candidates. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    base = base.where(F.col("vec_id").isNotNull() & finite_vector(F.col("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    # classes of length: fewer than 30,000 over the whole range of doubles
    group = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.lit(float(np.log(STEP))))).otherwise(-100_000).cast("long")
    # the written number is a row's own, also where ids repeat
    rows = ws.save(
        base.withColumn("norm", norm).select("vec_id", "vec", "norm", group.alias("class"), F.size("vec").cast("long").alias("dim"), F.monotonically_increasing_id().alias("uid")),
        "rows",
    )
    sizes = ws.save(rows.groupBy("class", "dim").agg(F.count("*").alias("n")), "sizes")
    placed = rows.join(F.broadcast(sizes) if sizes.count() <= MOST_CLASSES else sizes, ["class", "dim"])
    # the most frequent dimension, and the number of all rows
    common = sizes.groupBy("dim").agg(F.sum("n").alias("n")).select("dim", "n", F.sum("n").over(Window.partitionBy()).alias("all")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n_rows = (common[0]["dim"], common[0]["all"]) if common else (1, 0)
    each = min(BUCKET_ROWS, max(LEAST_ROWS, n_rows // (2 * partitions(spark))))
    salt = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / each))
    longest = rows.where(F.col("dim") == dim).orderBy(F.desc("norm"), "uid").limit(max(1, min(SEEDS, SEED_VALUES // dim))).select("uid", "vec").toArrow()
    seeds = longest["uid"].to_numpy(), np.array(longest["vec"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    asked = ws.save(
        rows.where(queries).select("uid", "vec_id", "vec", "dim")
        .mapInArrow(lean(_seeded(k, spark.sparkContext.broadcast(seeds))), "uid long, vec_id long, vec array<double>, dim long, floor double"),
        "asked",
    )
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    slices = max(1, -(-2 * partitions(spark) // blocks))
    first = asked.select(
        F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {slices - 1}L)")).alias("slice"),
        F.lit(0).cast("long").alias("role"), F.lit(0).cast("long").alias("bucket"), "dim", "uid", "vec_id", "floor", "vec",
    )
    then = placed.withColumn("salt", salt).select(
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
        F.pmod(F.xxhash64("class", "dim", "salt"), F.lit(slices)).alias("slice"),
        F.lit(1).cast("long").alias("role"), (F.col("class") * -(1 << 24) + F.col("salt")).alias("bucket"),  # longest first
        "dim", "uid", "vec_id", F.lit(None).cast("double").alias("floor"), "vec",
    )
    found = (
        first.unionByName(then)
        .repartition(blocks * slices, "block", "slice")
        .sortWithinPartitions("block", "slice", "role", "bucket", "dim", "vec_id")
        .mapInArrow(lean(_search(k)), "uid long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
