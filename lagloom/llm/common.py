"""Shared pieces of the corpus operators: written tables, text access, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: Rows of an Arrow batch at most: texts are long, and a batch is held several times on either side.
BATCH_ROWS = 2000
_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; a cluster without it
    is an error, since executors cannot see each other's disks.
    """
    global _local_root
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="lagloom-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``BATCH_ROWS`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Workspace:
    """Intermediate tables of one run, written as Parquet under :func:`shared_root`.

    Written tables cut the lineage and survive the loss of executors. ``drop`` removes those
    that the lazy result no longer reads; the rest may be removed after the job.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run, forget=None):
    """``run`` for mapInArrow, giving its memory back when a task ends: Python workers live on between stages.

    ``forget`` empties the caches that the task has filled.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's signed long."""
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64 (xor-shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def finite_vector(c: Column, floating: bool = True) -> Column:
    """True for a non-empty vector without null or non-finite components."""
    ok = c.isNotNull() & (F.size(c) > 0)
    return ok & F.forall(
        c,
        lambda x: F.coalesce(
            x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)
        ),
    )


def texts_as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column of a record batch; nulls become empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges(src, dst)``; component is the least id reachable.

    Each round hooks every node to its least neighbour and contracts the edges; the least node of
    a component keeps its own id in all rounds, so it ends as the label. Rounds grow with the
    logarithm of the size; only a flag whether edges are left comes to the driver.
    """
    order = lambda a, b: [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]
    e = ws.save(
        edges.where("src <> dst").select(*order(F.col("src"), F.col("dst"))).distinct(), f"{tag}-e0"
    )
    labels, k = None, 0
    while labels is None or not e.isEmpty():
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = ws.save(
            both.groupBy(F.col("src").alias("node")).agg(
                F.least(F.col("src"), F.min("dst")).alias("to")
            ),
            f"{tag}-m{k}",
        )
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(
                hook.select(F.col("node").alias("component"), "to"), "component", "left"
            ).select("node", F.coalesce("to", "component").alias("component"))
        a = hook.select(F.col("node").alias("src"), F.col("to").alias("ma"))
        b = hook.select(F.col("node").alias("dst"), F.col("to").alias("mb"))
        k += 1
        e = ws.save(
            e.join(a, "src").join(b, "dst").where("ma <> mb")
            .select(*order(F.col("ma"), F.col("mb"))).distinct(),
            f"{tag}-e{k}",
        )
        ws.drop(f"{tag}-e{k - 1}")
    out = ws.save(labels, f"{tag}-labels")
    ws.drop(*(f"{tag}-m{i}" for i in range(k)), f"{tag}-e{k}")
    return out
