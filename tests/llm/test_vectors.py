"""The vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import embed_dedup, topk
from lagloom.llm.queries import scaled

SCHEMA = "vec_id long, embedding array<float>, class int, block string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], SCHEMA)


def clustered(n=600, dim=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    x = centres[r.integers(0, 20, n)] + r.normal(0, 0.12, (n, dim))
    return (x * r.lognormal(0, 0.7, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("rows, seeds", [(50, 7), (4096, 2048), (50, 3)])
def test_top_products(spark, monkeypatch, rows, seeds):
    monkeypatch.setattr(topk, "BUCKET_ROWS", rows)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    x = clustered()
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(2000, None), (2050, [float("nan")] * 16), (2100, [None] * 16), (2150, []), (None, [1.0] * 16), (3000, [0.0] * 16), (3050, [1.0, 2.0])]
    data += [(i + 5000, x[i].tolist()) for i in range(60)]  # ties
    got = topk.top_products(frame(spark, data).select("vec_id", scaled("embedding").alias("vector"), "class", "block"), F.col("vec_id") % 50 == 0, 5)
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in data if i is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v)}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_top_products_of_repeated_ids(spark):
    """Rows that share an id are queries and candidates each; dimensions don't mix."""
    r = np.random.default_rng(8)
    data = [(i // 2, r.integers(-9, 9, 4 if i % 3 else 6).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, vector array<double>")
    got = sorted(tuple(x) for x in topk.top_products(df, F.col("vec_id") % 10 == 0, 3).collect())
    want = []
    for a, (q, x) in enumerate(data):
        if q % 10 == 0:
            best = sorted((-int(np.dot(x, y)), i) for b, (i, y) in enumerate(data) if a != b and len(x) == len(y))[:3]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_products_prunes():
    x = np.floor(256 * clustered().astype(float))
    b = topk._Bucket(np.arange(len(x)), np.arange(len(x)), x)
    q = x[7]
    length, scores = float(np.linalg.norm(q)), b.vecs @ q
    for floor in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
        at = b.candidates(q, length, float(floor))
        inside = np.zeros(len(x), bool)
        inside[at] = True
        assert inside[scores >= floor].all()
    assert inside.sum() < len(x)


def test_empty_vectors(spark):
    none = frame(spark, [])
    assert embed_dedup.near_vectors(none).count() == 0
    assert topk.top_products(none.withColumn("vector", F.col("embedding")), F.col("vec_id") >= 0).count() == 0
    one = embed_dedup.near_vectors(frame(spark, [(1, None), (2, [0.0, 0.0])])).collect()
    assert {tuple(r) for r in one} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)  # groups take many blocks
    x = clustered(500)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[0].tolist()) for i in range(30)]
    data += [(1000, None), (1001, [0.0] * 16), (1002, [float("inf")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame(spark, data)).collect()}
    ok = [(i, np.array(v, float)) for i, v in data if i is not None and i < 1000]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    m /= np.linalg.norm(m, axis=1)[:, None]
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    links = np.array([got[i]["n_links"] for i in ids])
    assert (links <= link.sum(axis=1)).all()
    assert links.sum() >= 0.98 * link.sum()
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min(label[a], label[link[a]].min(initial=label[a])) for a in range(len(ids))])
        if (new == label).all():
            break
        label = new
    comp = {int(i): int(ids[np.flatnonzero(label == l)].min()) for i, l in zip(ids, label)}
    assert np.mean([got[i]["component_id"] == comp[i] for i in comp]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004))
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_vectors_of_several_dimensions(spark, monkeypatch):
    """Links within each dimension, small ones and one with tables, and of rows that share an id."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    x = clustered(200, 16)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [1.0, 2.0]), (301, [1.0, 2.0]), (302, [2.0, -1.0]), (400, [1.0, 0.0, 0.0])]
    data += [(500, [0.0, 1.0, 0.0]), (500, [0.0, 0.0, 1.0]), (450, [0.0, 0.01, 1.0])]
    got = [tuple(r) for r in embed_dedup.near_vectors(frame(spark, data)).collect()]
    assert len(got) == len(data)
    assert {r[1:] for r in got if r[0] in (300, 301)} == {(1, 300, True), (1, 300, False)}
    assert {r for r in got if r[0] in (302, 400)} == {(302, 0, 302, True), (400, 0, 400, True)}
    assert sorted(r for r in got if r[0] in (450, 500)) == [(450, 1, 450, True), (500, 0, 500, True), (500, 1, 450, False)]
    m = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert sum(r[1] for r in got if r[0] < 200) >= 0.98 * ((m @ m.T >= 0.95).sum() - 200)
    monkeypatch.setattr(embed_dedup, "MOST_DIMENSIONS", 2)
    with pytest.raises(ValueError):
        embed_dedup.near_vectors(frame(spark, data))


def test_a_dense_block_takes_little_memory():
    """A pair of blocks in which every vector is near every other."""
    import resource

    import pyarrow as pa

    n, dim, tables = 2 * embed_dedup.BLOCK, 64, 60
    r = np.random.default_rng(9)
    x = 1 + 0.01 * r.normal(size=(n, dim))
    column = lambda v: pa.array(np.broadcast_to(v, n).astype(np.int64))
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
    keys = r.integers(0, 9, (n, tables)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([column(dim), column(tables - 1), *(column(0) for _ in range(2)), column(1), column(np.arange(n)), column(np.arange(n) % 2), column(1), lists(x), lists(keys)], list("abcdefghij"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert list(embed_dedup._linked(0.95)([batch]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150 << 10


def test_rotation_is_orthogonal():
    r = embed_dedup.learn_rotation(clustered().astype(float), 1)
    assert np.allclose(r @ r.T, np.eye(16))


def test_tables_bring_pairs_together_despite_a_common_mean():
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.9) * unit(r.normal(size=64)) + np.sqrt(0.1) * unit(r.normal(size=(1500, 64))))
    codes = embed_dedup.Codes.fit(x[:1000], 100_000, 0.95, 1)
    noise = r.normal(size=x.shape)
    partner = 0.95 * x + np.sqrt(1 - 0.95**2) * unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    assert codes.tables <= embed_dedup.MOST_TABLES
    assert (codes.keys(x) == codes.keys(partner)).any(axis=1).mean() > 0.98
