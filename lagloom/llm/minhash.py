"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, lean, mix64, texts_as_bytes

BANDS, ROWS, BITS = 24, 4, 2
K = BANDS * ROWS
WORDS64 = K * BITS // 64
#: An estimate this much under the similarity asked for (5 standard deviations) is not checked.
MARGIN = 0.25
#: Rows and shingles of a block of a bucket; tokens whose matrix is made at once.
BLOCK, BLOCK_SHINGLES, TOKENS = 1024, 1 << 19, 1024
PAIRS_PER_TASK = 128
#: Words whose hashes a task keeps.
CACHE = 100_000
#: Counters by which shingles are ordered from rare to frequent.
SLOT_BITS = 18
#: Bits by which documents are told that may be in a bucket with others.
MEMBER_BITS = 26


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def forget() -> None:
    _words.clear()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    A-Z are lower-cased and words split at ASCII white space, as bytes.lower and bytes.split do.
    Fewer words than ``width`` make one shingle, no words none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    wide = min(n, width)
    acc = np.full(n - wide + 1, wide, np.uint64)
    for j in range(wide):
        acc = mix64(acc) if j == 0 else acc * np.uint64(0x9FB21C651E98DF25)
        acc = acc + h[j : n - wide + 1 + j]
    return np.unique(mix64(acc))


@functools.cache
def _multipliers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**64, K, np.uint64) | np.uint64(1)
    return a, r.integers(0, 2**64, K, np.uint64)


def minima(shingles: np.ndarray, seed: int) -> np.ndarray:
    a, b = _multipliers(seed)
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(out, (shingles[i : i + 512, None] * a + b).min(axis=0), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, side by side in int64 words."""
    bits = np.stack([(low >> np.uint64(i)) & np.uint64(1) for i in range(BITS)], axis=-1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    acc = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + low.reshape(BANDS, ROWS)[:, j])
    return acc.view(np.int64)


def _signatures(width: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, fps, sigs, bands = [], [], [], []
            for text in texts_as_bytes(batch.column(1)):
                s = shingle_set(text, width)
                n.append(len(s))
                if not len(s):
                    fps.append((None, None)), sigs.append([None] * WORDS64), bands.append([])
                    continue
                low = minima(s, seed)
                fps.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())
                sigs.append(packed(low).tolist())
                bands.append(band_keys(low))
            cols = [pa.array(c, pa.int64()) for c in (*zip(*fps), *zip(*sigs))] or [pa.array([], pa.int64())] * (2 + WORDS64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *cols, pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fa", "fb", *(f"s{i}" for i in range(WORDS64)), "bands"],
            )

    return run


def _sets(width: int, bits):
    """(id, shingles) of the rows (id, text, hashed) whose bit is set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            sets = [shingle_set(t, width).tobytes() for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of num / den at least."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _confirm(num: int, den: int):
    """Reads (a, salt, role, id, shingles) in order: a's set (role 0), then its partners'."""

    def run(batches):
        import pyarrow as pa

        now, heads = None, []
        for batch in batches:
            found = []
            for a, salt, role, other, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != (a, salt):
                    now, heads = (a, salt), []
                s = np.frombuffer(blob, np.uint64)
                if role == 0:
                    heads.append(s)
                    continue
                if any(alike(h, s, num, den) for h in heads):
                    found.append((a, other))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["src", "dst"])

    return run


def least_matches(similarity: float) -> float:
    """Collision-corrected: agreeing groups that an estimate of ``similarity - MARGIN`` needs."""
    by_chance = 2.0**-BITS
    return K * (by_chance + (1 - by_chance) * (similarity - MARGIN))


def _by_block(made):
    """Reads rows ordered by (key, bi, bj); calls ``made`` with the batches of each such block."""

    def run(batches):
        now, rows = None, []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if now is not None and tuple(key[start]) != now:
                    yield from made(now[0], rows)
                    rows = []
                now = tuple(key[start])
                rows.append(batch.slice(start, end - start))
        if rows:
            yield from made(now[0], rows)

    return run


def _column(rows, i: int) -> np.ndarray:
    return np.concatenate([r.column(i).to_numpy() for r in rows])


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with other sets[right], as products of incidence matrices."""
    sizes = np.array([len(x) for x in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[token]
    who, token = who[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    # a row's place on either side
    rows = [np.full(len(sets), -1) for _ in (left, right)]
    rows[0][left], rows[1][right] = np.arange(len(left)), np.arange(len(right))
    exact = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64
    out = np.zeros((len(left), len(right)), exact)
    for start in range(0, int(shared.sum()), TOKENS):
        here = slice(*np.searchsorted(token, [start, start + TOKENS]))
        x, y = np.zeros((len(left), TOKENS), exact), np.zeros((len(right), TOKENS), exact)
        for m, at in ((x, rows[0][who[here]]), (y, rows[1][who[here]])):
            m[at[at >= 0], token[here][at >= 0] - start] = 1
        out += x @ y.T
    return out


def _joining(num: int, den: int):
    """Links that join components within a block (key, bi, bj, id, comp, side, shingles): n components give n - 1 at most."""

    def links(a, b, ids, label):
        """Spanning pairs of a[i]-b[i] over the components in ``label``, which is brought up to date."""
        while len(a):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if len(a):
                yield int(ids[a[0]]), int(ids[b[0]])
                label[label == label[b[0]]] = label[a[0]]

    def made(_, rows):
        import pyarrow as pa

        ids, side = _column(rows, 3), _column(rows, 5)
        label = np.unique(_column(rows, 4), return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint64) for r in rows for x in r.column(6).to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out: list[tuple[int, int]] = []
        if len(left) * len(right) <= 100:
            for i in left.tolist():
                for j in right.tolist():
                    if label[i] != label[j] and alike(sets[i], sets[j], num, den):
                        out += links(np.array([i]), np.array([j]), ids, label)
        else:
            both = intersections(sets, left, right)
            for s in range(0, len(left), 256):
                rows_ = left[s : s + 256]
                inner = both[s : s + 256]
                a, b = np.nonzero((den + num) * inner >= num * (size[rows_][:, None] + size[right][None, :]))
                out += links(rows_[a], right[b], ids, label)
        if out:
            x, y = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["src", "dst"])

    return _by_block(made)


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches):
    """(slot, n): how many shingles of the sets fall on each counter."""
    import pyarrow as pa

    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(slots(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])


def prefix(shingles: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of similarity num / den share one of them.

    Any order that all sets follow serves; rare shingles first keep passages that many documents share out.
    """
    most = len(shingles) - -(-num * len(shingles) // den) + 1
    return shingles[np.lexsort((shingles, counts[slots(shingles)]))[:most]]


def _prefixes(counts, num: int, den: int):
    """(key, id, comp) for each shingle in the prefix of a row (id, comp, shingles)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            found = [prefix(x, counts.value, num, den) for x in sets]
            rows = np.repeat(np.arange(len(sets)), [len(x) for x in found])
            keys = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(batch.column(i).to_numpy()[rows]) for i in (0, 1))], ["key", "id", "comp"])

    return run


def blocks_of(n: str, hashed: str, block: int):
    """(bi, bj, side) structs that put each row of a bucket of n rows into all its pairs of blocks.

    side 2 stands for both sides (a block with itself).
    """
    return F.expr(
        f"""transform(sequence(0, cast(ceil({n} / {block}) as int) - 1), j -> named_struct(
            'bi', least(j, cast(pmod({hashed}, ceil({n} / {block})) as int)),
            'bj', greatest(j, cast(pmod({hashed}, ceil({n} / {block})) as int)),
            'side', case when j = pmod({hashed}, ceil({n} / {block})) then 2
                         when j > pmod({hashed}, ceil({n} / {block})) then 0 else 1 end))"""
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    similarity: float = 0.8, seed: int = 1,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, by Jaccard similarity of word shingles.

    Texts with equal shingle sets form one class, kept as its smallest id; only these go on. Of
    each, 96 minima give 24 bands of 4 for the search and 2 low bits each for a packed signature.
    Candidates that agree in a band and whose bit count, corrected for chance, is not 5 standard
    deviations under ``similarity`` are confirmed on whole sets: first every member of a bucket with the
    bucket's smallest id, which joins groups of copies. A bucket that still holds several components (a
    shared passage brings unlike documents together) is looked through again, but only those of its
    documents that share one of their rarest shingles with another component, as two similar sets
    must: these meet with their sets in one task per pair of blocks of the bucket, which returns the links that
    join components. So rows grow with the documents, never with the pairs of a group, and no link that
    would join components is lost. A pair at the threshold shares no band with probability 3e-6.

    Null, empty and blank texts: n_shingles 0, linked with nothing, kept. Null ids: component_id
    null, kept. Rows that share an id count as one document: linked, all with that id's component.
    An empty table gives an empty result; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    ratio = Fraction(str(similarity))
    num, den, least = ratio.numerator, ratio.denominator, least_matches(similarity)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = [f"s{i}" for i in range(WORDS64)]
    sigs = ws.save(
        base.mapInArrow(
            lean(_signatures(width, seed), forget),
            f"doc_id long, n_shingles long, fa long, fb long, {', '.join(f'{w} long' for w in words)}, bands array<long>",
        ),
        "signatures",
    )
    usable = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = ws.save(usable.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep")), "classes")
    reps = ws.save(
        usable.join(classes.select("rep", F.col("fa").alias("ra"), F.col("fb").alias("rb")), F.expr("doc_id = rep and fa = ra and fb = rb"), "left_semi")
        .select(F.col("doc_id").alias("id"), *words, "bands"),
        "reps",
    )
    rows = reps.select("id", F.explode("bands").alias("key"))
    # written, as are the mixed keys below, so that the join with a crowded key's rows can be split
    heads = ws.save(rows.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    shared = ws.save(rows.join(heads, "key"), "shared")
    # a bit for each member instead of a join, which would move the texts; others with a member's bit only get a set in vain
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MEMBER_BITS))
    member = shared.select(hashed("id").alias("h")).select(F.shiftright("h", 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    table = member.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << MEMBER_BITS - 6, np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    sets = ws.save(
        base.where("doc_id is not null").select("doc_id", "text", hashed("doc_id").alias("hashed"))
        .mapInArrow(lean(_sets(width, spark.sparkContext.broadcast(bits)), forget), "id long, shingles binary"),
        "sets",
    )
    marks = reps.select("id", *words)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs(a, b); a hot a is dealt to several tasks."""
        tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("salts"))
        partners = (
            pairs.join(tasks, "a").join(sets.withColumnRenamed("id", "b"), "b")
            .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"), "shingles")
        )
        first = tasks.join(sets.withColumnRenamed("id", "a"), "a").select(
            "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"), "shingles"
        )
        return ws.save(
            first.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")
            .mapInArrow(lean(_confirm(num, den)), "src long, dst long"),
            name,
        )

    same = F.lit(0)
    for w in words:
        d = F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))
        wide = d
        for k in range(1, BITS):
            wide = wide.bitwiseOR(F.shiftrightunsigned(d, k))
        same = same + F.bit_count(F.bitwise_not(wide).bitwiseAND(F.lit(0x5555555555555555)))
    tested = ws.save(
        shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        .join(marks.select(F.col("id").alias("a"), *(F.col(w).alias(f"x{w}") for w in words)), "a")
        .join(marks.select(F.col("id").alias("b"), *(F.col(w).alias(f"y{w}") for w in words)), "b")
        .where(same >= least).select("a", "b"),
        "pairs0",
    )
    links = confirmed(tested, "links0")
    parts = connected_components(ws, links, "cc0")
    now = ws.save(
        shared.join(parts, shared.id == parts.node, "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "now"
    )

    mixed = ws.save(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
    unsure = now.join(mixed, "key", "left_semi")
    parted = ws.save(
        unsure.select("id", "comp").distinct().join(sets, "id").select("id", "comp", "shingles", (F.octet_length("shingles") / 8).cast("long").alias("size")), "parted"
    )
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    # one row for each counter at most
    table = parted.select("shingles").mapInArrow(lean(_slot_counts), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    sent = spark.sparkContext.broadcast(counts)
    prefixes = ws.save(parted.select("id", "comp", "shingles").mapInArrow(lean(_prefixes(sent, num, den)), "key long, id long, comp long"), "prefixes")
    crowded = prefixes.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    doubtful = ws.save(prefixes.join(crowded, "key", "left_semi").select("id").distinct(), "doubtful")
    again = ws.save(unsure.select("key", "id").join(doubtful, "id", "left_semi").join(parted.select("id", "comp", "size"), "id"), "again")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES))
    totals = ws.save(
        again.groupBy("key").agg(blocks.alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "blocks"), "totals"
    )
    dealt = (
        again.join(totals, "key").withColumn("hashed", F.xxhash64("id")).withColumn("block", F.explode(blocks_of("blocks", "hashed", 1)))
        .select("key", "block.bi", "block.bj", "id", "comp", "block.side").join(parted.select("id", "shingles"), "id")
        .select("key", "bi", "bj", "id", "comp", "side", "shingles")
        .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id")
    )
    more = ws.save(dealt.mapInArrow(lean(_joining(num, den)), "src long, dst long"), "links1")
    if not more.isEmpty():
        parts = connected_components(ws, links.unionByName(more), "cc1")
    ws.drop("shared", "heads", "mixed", "totals", "sets", "parted", "prefixes", "again", "reps")
    unlinked = F.coalesce("component", "rep", "doc_id")
    return (
        sigs.select("doc_id", "n_shingles", "fa", "fb")
        .join(classes, ["fa", "fb"], "left")
        .join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("doc_id", "n_shingles", unlinked.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
