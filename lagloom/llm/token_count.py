"""Token counts: pieces once per distinct pre-token, joined to pre-token frequencies."""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_text import PLAIN, SPACED, lettered, tokenizer
from .common import Workspace, lean

#: Entries, and bytes of text, that the broadcast table of common pre-tokens has at most; longer pre-tokens are never in it.
COMMON, COMMON_BYTES, LONGEST = 262_144, 4 << 20, 64
#: Pre-tokens that a task counts before it hands them on.
HELD = 200_000
#: Frequency classes per doubling.
FINE = 8


@functools.cache
def _special(path: str):
    found = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def pretokens(text: str, path: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special tokens stand between them."""
    marks, special = 0, _special(path)
    parts = [text]
    if special is not None and "<" in text and special.search(text):
        parts = special.split(text)
        marks = len(parts) - 1
    out: list[str] = []
    for part in parts:
        if PLAIN(part):
            out += SPACED(part)
        elif part:
            out += [part[s:e] for _, (s, e) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    return out, marks


def _frequencies(path: str):
    def run(batches):
        import pyarrow as pa

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(pretokens(text, path)[0])
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    return run


def _pieces(path: str):
    def run(batches):
        import pyarrow as pa

        model = tokenizer(path).model
        for batch in batches:
            k = [len(model.tokenize(lettered(x))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k, pa.int64())], ["piece", "n", "k"])

    return run


def _documents(path: str, common):
    def run(batches):
        import pyarrow as pa

        known = _table(common)
        get = known.get
        for batch in batches:
            sizes, sums, pieces, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                units, total = pretokens(text, path)
                frequencies = Counter(units)
                ks = list(map(get, frequencies))
                rare = [(u, n) for (u, n), k in zip(frequencies.items(), ks) if k is None] if None in ks else []
                total += sum(n * k for n, k in zip(frequencies.values(), ks) if k is not None)
                sizes.append(len(text.encode()))
                sums.append(total)
                pieces.append([u for u, _ in rare])
                counts.append([n for _, n in rare])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "known", "pieces", "counts"],
            )

    return run


_tables: dict = {}


def _table(common) -> dict[str, int]:
    """The broadcast table as a dict, made once per worker."""
    if common.id not in _tables:
        _tables.clear()
        pieces, ks = common.value
        _tables[common.id] = dict(zip(pieces, ks))
    return _tables[common.id]


class _Common:
    """A broadcast with an identity of its own, which survives pickling."""

    def __init__(self, spark, value):
        self.sent = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.sent.value


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, for a byte-level BPE file.

    One pass sums the frequency of each pre-token over the corpus (counted per task before the
    shuffle); each distinct pre-token's pieces are counted once. A second pass makes each document's
    frequencies of pre-tokens and joins them to these counts: those of the most frequent pre-tokens,
    never over ``COMMON`` entries and ``COMMON_BYTES``, as a broadcast, all others by a shuffle. Sums of
    frequency times pieces are the tokens. No ids are made.

    Special strings in a text are one token each, as in the library. Null and empty text: 0 bytes,
    0 tokens. Null ids and repeated rows: one result per row, as for any other. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "token-count")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = ws.save(
        base.select("text").mapInArrow(lean(_frequencies(tokenizer_path)), "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .mapInArrow(lean(_pieces(tokenizer_path)), "piece string, n long, k long")
        .withColumn("class", F.when(F.octet_length("piece") <= LONGEST, F.floor(F.log2("n") * FINE)).otherwise(-1).cast("int")),
        "vocabulary",
    )
    # a row for each frequency class: 64 * FINE at most
    classes = vocabulary.where("class >= 0").groupBy("class").agg(F.count("*").alias("rows"), F.sum(F.octet_length("piece")).alias("bytes")).collect()
    least, rows, size = 1 << 30, 0, 0
    for r in sorted(classes, key=lambda r: -r["class"]):
        rows, size = rows + r["rows"], size + r["bytes"]
        if rows > COMMON or size > COMMON_BYTES:
            break
        least = r["class"]
    table = vocabulary.where(F.col("class") >= least).select("piece", F.col("k").cast("int").alias("k")).toArrow()
    common = _Common(spark, (table["piece"].to_pylist(), np.array(table["k"], np.int64).tolist()))
    per_doc = ws.save(
        base.mapInArrow(lean(_documents(tokenizer_path, common)), "doc_id long, n_bytes long, known long, pieces array<string>, counts array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "documents",
    )
    rest = vocabulary.where(F.col("class") < least).select("piece", "k")
    sums = (
        per_doc.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("p"))
        .select("row", F.col("p.pieces").alias("piece"), F.col("p.counts").alias("freq"))
        .join(rest.hint("shuffle_hash"), "piece")
        .groupBy("row").agg(F.sum(F.col("freq") * F.col("k")).alias("more"))
    )
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return per_doc.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")
    )
