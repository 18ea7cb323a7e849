"""The document operators against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagloom.llm import chat, language_id, line_dedup, merge_dropout, minhash, packing, sharding, token_count

SCHEMA = "doc_id long, text string, lang string, source string, shard int, hi long, component string, n long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def rows():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " ", "\n\n", "x", "Tiny", base, base, " ".join(near), base.upper(),
        "a shared line of text\n" + prose(30) + "\n  A Shared Line of Text \nshort", "own\na shared line of text",
        prose(30000), "é" * 12 + "\n" + "É" * 12, "日本語のテキスト <|endoftext|> 'S don't  \t", "\x1c\x85\xa0 ΑΣ Σ İ ﬁ", "1 2 3 4", "▁ mark ▁▁", "!!! 123 ---",
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["hot", "hot", "cold", None][i % 4], 1, 2, "c", 3) for i, t in enumerate(texts)]
    out += [(40 + i, " ".join(near[: 100 + i]), "en", "hot", 1, 2, "c", 3) for i in range(12)]
    return out + [out[6], (None, "no id here\na shared line of text", None, None, 1, 2, "c", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none, spark):
    path = public_tokenizers.path
    for out in (
        line_dedup.dedup_lines(none), minhash.near_duplicates(none), token_count.token_counts(none, path("byte_bpe_50k.json")),
        sharding.interleave(none), language_id.language_id(none), merge_dropout.encode(none, path("piece_bpe_32k.model")),
        packing.pack(none, path("word_bpe_49k.json")),
        chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0


def test_line_dedup(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, *_ in rows():
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    held[key(x)].add(d)
    want = []
    for d, t, *_ in rows():
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if d is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == d]
        want.append((d, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    carried = line_dedup.dedup_lines(docs, carry=("hi", "n", "component"))
    assert carried.columns[4:] == ["hi", "n", "component"] and carried.where("hi = 2 and n = 3").count() == len(want)


@pytest.mark.parametrize("sent", [0, 1000])
def test_line_dedup_hot_line(spark, monkeypatch, sent):
    """A hot shard's index is copied to many tasks; the table of such shards is broadcast or joined."""
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", 50)
    monkeypatch.setattr(line_dedup, "LEAST_LINES", 10)
    monkeypatch.setattr(line_dedup, "LEAST_KEYS", 20)
    monkeypatch.setattr(line_dedup, "MOST_SENT", sent)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nline number "), F.col("id").cast("string")).alias("text"))
    out = line_dedup.dedup_lines(df)
    assert out.where("doc_id > 0 and n_dropped = 1").count() == 399 and out.where("doc_id = 0 and n_dropped = 0").count() == 1


def test_perfect_hash():
    r = np.random.default_rng(1)
    hi, lo = r.integers(0, 2**64, (2, 5000), np.uint64)
    mph = line_dedup.PerfectHash.build(hi, lo)
    assert sorted(mph.find(hi, lo).tolist()) == list(range(5000))
    hi[:50] = 7  # equal halves are told apart by the other
    assert sorted(line_dedup.PerfectHash.build(hi, lo).find(hi, lo).tolist()) == list(range(5000))
    assert len(line_dedup.PerfectHash.build(hi[:0], lo[:0]).find(hi, lo)) == 5000


def brute_near(data, width, similarity):
    sets = {}
    for d, t, *_ in data:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        sets.setdefault(d, set()).add(frozenset(s))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and len(x & y) >= similarity * len(x | y) - 1e-12 for x in sets[a] for y in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, width):
    want = brute_near(rows(), width, 0.8)
    got = minhash.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert {r["n_shingles"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {0}


def test_near_duplicates_large_group(spark, monkeypatch):
    """A group whose members are linked only through one another, in many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PAIRS_PER_TASK", 8)
    r = random.Random(2)
    base, data = [f"w{i}" for i in range(150)], []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(150)] = f"u{r.random()}"
        data.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=4).collect()
    want = brute_near(data, 4, 0.8)
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_intersections(monkeypatch):
    monkeypatch.setattr(minhash, "TOKENS", 7)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 40, 5, 40, 12)]
    left, right = np.array([0, 2, 3, 6]), np.array([1, 4, 5])
    assert (minhash.intersections(sets, left, right) == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]).all()


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(4)
    counts = r.integers(0, 5, 1 << minhash.SLOT_BITS)
    for _ in range(300):
        base = np.unique(r.integers(0, 2**64, r.integers(1, 60), np.uint64))
        x, y = (base[r.random(len(base)) > r.choice([0, 0.1])] for _ in range(2))
        if len(x) and len(y) and minhash.alike(x, y, 4, 5):
            assert np.intersect1d(minhash.prefix(x, counts, 4, 5), minhash.prefix(y, counts, 4, 5)).size


def test_a_full_pair_of_blocks_takes_little_memory():
    """Two blocks of documents that are all unlike but share most of their shingles."""
    import resource

    import pyarrow as pa

    n = 2 * minhash.BLOCK
    r = np.random.default_rng(5)
    common = r.integers(0, 2**64, 300, np.uint64)
    sets = [np.sort(np.concatenate([common, r.integers(0, 2**64, 150, np.uint64)])).tobytes() for _ in range(n)]
    column = lambda x: pa.array(np.broadcast_to(x, n).astype(np.int64))
    batch = pa.RecordBatch.from_arrays([column(1), column(0), column(1), column(np.arange(n)), column(np.arange(n)), column(np.arange(n) % 2), pa.array(sets, pa.binary())], list("abcdefg"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert not list(minhash._joining(4, 5)([batch]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150 << 10
    near = [np.sort(np.concatenate([common, r.integers(0, 2**64, 20, np.uint64)])).tobytes() for _ in range(n)]
    found = list(minhash._joining(4, 5)([batch.set_column(6, "g", pa.array(near, pa.binary()))]))
    assert sum(len(x) for x in found) == n - 1


def test_shared_passage_grows_in_proportion(spark, monkeypatch, tmp_path):
    """Unlike documents around one passage: one hot bucket, few rows; pairs hidden among them are found."""
    written = {}
    save = minhash.Workspace.save
    monkeypatch.setattr(minhash.Workspace, "save", lambda self, df, name: written.setdefault(name, save(self, df, name)))
    monkeypatch.setattr(minhash.Workspace, "drop", lambda *a: None)
    monkeypatch.setattr(minhash, "BLOCK", 256)
    r = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows_ = []
    for i in range(3000):
        own = [f"d{i}x{j}" for j in range(30)] if i % 100 else [f"d{i // 200}y{j}" for j in range(29)] + [f"z{i}"]
        rows_.append((i, " ".join(passage + own)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got == {i: i if i % 100 else i // 200 * 200 for i in range(3000)}
    assert written["again"].count() < 3000 and written["prefixes"].count() < 3000 * 20


def test_minhash_estimate():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 2**64, 900, np.uint64))
    y = np.unique(np.concatenate([x[:800], r.integers(0, 2**64, 100, np.uint64)]))
    true, est = 800 / 1000, []
    for seed in range(20):
        a, b = (np.unpackbits(minhash.packed(minhash.minima(s, seed)).view(np.uint8), bitorder="little").reshape(-1, minhash.BITS) for s in (x, y))
        m = (a == b).all(axis=1).sum() / minhash.K
        est.append((m - 0.25) / 0.75)
    assert abs(np.mean(est) - true) < 0.04


@pytest.mark.parametrize("common, size", [(5, 1 << 20), (1 << 20, 60), (1 << 20, 1 << 20)])
def test_token_counts(docs, monkeypatch, common, size):
    """Most pre-tokens take the join, by number or by bytes, or few do."""
    monkeypatch.setattr(token_count, "COMMON", common)
    monkeypatch.setattr(token_count, "COMMON_BYTES", size)
    monkeypatch.setattr(token_count, "LONGEST", 8)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, *_ in rows()]
    got = [tuple(r) for r in token_count.token_counts(docs, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sharding(docs):
    got = sharding.interleave(docs, shards=4).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1 and len(by) == 4
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows())


def test_sharding_mixture_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED_TOGETHER", 100)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = sharding.interleave(df, shards=8)
    mix = got.groupBy("source").pivot("shard", list(range(8))).count().collect()
    for row in mix:
        counts = [row[str(i)] or 0 for i in range(8)]
        assert max(counts) - min(counts) <= 2
    again = sharding.interleave(df.repartition(7), shards=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_language_id(spark, docs, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    mine = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(mine[i]["lang_pred"] == "und" and mine[i]["score"] == 0 for i in (0, 1, 2, 3, 16, 18))
    assert all(mine[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in mine if i is not None)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}


def brute_language(rows, langs, text):
    """Word-first backoff by its definition, one word at a time, over dictionaries."""
    counts = [{}, {}]
    for lang, kind, gram, n in rows:
        counts[kind].setdefault(gram, {})[lang] = n
    total = {lang: 0.5 * (len(counts[0]) + 1) + sum(c.get(lang, 0) for c in counts[0].values()) for lang in langs}
    of_length = {
        n: {lang: 0.5 * (sum(len(g) == n for g in counts[1]) + 1) + sum(c.get(lang, 0) for g, c in counts[1].items() if len(g) == n) for lang in langs}
        for n in range(1, 6)
    }
    out = dict.fromkeys(langs, 0.0)
    for word in language_id.WORD(text.lower()):
        if word in counts[0]:
            for lang in langs:
                out[lang] += np.log((counts[0][word].get(lang, 0) + 0.5) / total[lang])
            continue
        w, i = f"<{word}>", 0
        while i < len(w):
            n = next((n for n in range(min(5, len(w) - i), 0, -1) if w[i : i + n] in counts[1]), 1)
            for lang in langs:
                out[lang] += np.log((counts[1].get(w[i : i + n], {}).get(lang, 0) + 0.5) / of_length[n][lang])
            i += n
    best = max(langs, key=lambda lang: (out[lang], -langs.index(lang)))
    return best, 1 / sum(np.exp(out[lang] - out[best]) for lang in langs)


def test_language_scores_are_those_by_definition(spark, sf):
    labelled = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null").limit(60).collect()]
    langs = sorted({lang for lang, _ in labelled})
    words, parts = {}, {}
    for lang, text in labelled[:30]:
        for w in language_id.WORD(text.lower())[:120]:
            words[lang, w] = words.get((lang, w), 0) + 1
            for n in range(1, 6):
                for g in language_id.grams(w, n):
                    parts[lang, g] = parts.get((lang, g), 0) + 1
    rows = [(lang, 0, w, n) for (lang, w), n in words.items()] + [(lang, 1, g, n) for (lang, g), n in parts.items() if n > 2]
    model = language_id.Model.fit(rows, langs)
    texts = [t[:600] for _, t in labelled] + ["straße ǅungla 𝔘nd 日本", "x"]
    for text, (lang, score) in zip(texts, model.predict_many(texts)):
        want = brute_language(rows, langs, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4
    before = [model.predict(t) for t in texts]
    assert [x[0] for x in before] == [x[0] for x in model.predict_many(texts)]


def test_three_hundred_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CACHE", (300 * 8 + 200) * 40)  # 40 words
    name = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
    r = random.Random(1)
    text = lambda i: " ".join(f"{name(i)}{r.choice('aeiou')}{r.choice('klmn')}" for _ in range(30))
    data = [(4 * i + j, text(i), f"l{i:03}") for i in range(300) for j in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(df, docs_per_language=3)
    assert len(model.langs) == 300
    got = language_id.identify(df, model, keep=("doc_id", "lang")).collect()
    assert all(x["lang"] == x["lang_pred"] for x in got)
    monkeypatch.setattr(language_id, "MOST_LABELS", 299)
    with pytest.raises(ValueError):
        language_id.train(df)


def test_language_backoff():
    m = language_id.Model.fit([("a", 0, "cat", 9), ("b", 0, "chat", 9), *(("a", 1, g, 5) for g in ("<ca", "at>", "t")), *(("b", 1, g, 5) for g in ("<ch", "ha"))], ["a", "b"])
    assert m.predict("cat cat")[0] == "a" and m.predict("chat")[0] == "b"
    assert m.predict("chaz")[0] == "b" and m.predict("caat")[0] == "a"


def test_merge_dropout(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = merge_dropout.encode(docs, path, dropout=0.2, seed=3)
    got = out.collect()
    assert len(got) == len(rows()) and all(r["lossless"] for r in got)
    texts = [r["text"] for r in merge_dropout.decode(out, path).collect()]
    assert sorted(texts) == sorted(t or "" for _, t, *_ in rows())
    plain = merge_dropout.Encoder(path, 0.0, 1)
    for _, t, *_ in rows():
        if t and "▁" not in t:
            assert plain.encode(t, 1).tolist() == sp.encode(t)
    again = merge_dropout.encode(docs.repartition(3), path, dropout=0.2, seed=3).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in again) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got)
    other = merge_dropout.encode(docs, path, dropout=0.2, seed=4)
    assert other.where("doc_id = 6").first()["ids"] != out.where("doc_id = 6").first()["ids"]


def test_merge_agendas_agree():
    v = merge_dropout.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    units = ["▁" + "".join(r.choice("etaoinshrdlué日") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    for limit in (0, 9000, 40000):
        many = merge_dropout.Segmentations(v, limit).look_up(units, np.full(len(units), 99, np.uint64))
        assert many == [b"".join(map(v.coded, merge_dropout.segment(u, v, limit, 99))) for u in units]
        bits = merge_dropout.skips(np.arange(4000, dtype=np.uint64) * np.uint64(977), 1, limit)
        share = np.unpackbits(bits[:, None], axis=1).mean(axis=0)
        assert np.abs(share - limit / 65536).max() < 0.03


def test_merge_dropout_of_each_occurrence(monkeypatch):
    monkeypatch.setattr(merge_dropout, "CACHE", 50)  # segmentations are dropped and made again
    monkeypatch.setattr(merge_dropout, "SLICE", 100)
    e = merge_dropout.Encoder(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1)
    text = " ".join(random.Random(2).choices([*WORDS, "interdependence", "x" * 70, "日本語"], k=700))
    units, keys = e.units(text), e.keys(7, 700)
    want = b"".join(b"".join(map(e.v.coded, merge_dropout.segment(u, e.v, e.limit, int(k)))) for u, k in zip(units, keys))
    assert e.encode(text, 7).tobytes() == want
    # a unit with a single merge is split in a tenth of its places, and a longer one in more than eight ways
    rare = next(p for p in e.v.rank if len(p) == 2 and p[0] == "▁" and p[1].isalpha())
    single = [e.kept.look_up([rare] * 20_000, e.keys(i, 20_000)) for i in range(2)]
    for ids in single:
        assert 0.09 < np.mean([len(x) == 8 for x in ids]) < 0.11
    assert single[0] != single[1]
    assert len(set(e.kept.look_up(["▁interdependence"] * 20_000, e.keys(1, 20_000)))) > 30


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64, with_ids=True).collect()
    whole, seq = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for d, x, *_ in rows():
        want = t.encode(x or "", add_special_tokens=False).ids + [1]
        pieces = sorted(set((s, tuple(i)) for s, i in whole[d]))
        assert [i for _, p in pieces for i in p] == want
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    # as many sequences as best fit decreasing opens, piece by piece
    rooms: list[int] = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [room for room in rooms if room >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - length)
    assert len(seq) == len(rooms)


def test_many_rows_without_id(spark, monkeypatch):
    """Rows that are alike in all and have no id are spread over ranges and buckets, and each keeps its place."""
    monkeypatch.setattr(sharding, "RANKED_TOGETHER", 50)
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)
    df = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 600, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    placed = sharding.interleave(df, shards=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(s, i) for s in range(4) for i in range(225)]
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), size=16).collect()
    spots = [(r["sequence_id"], r["offset"]) for r in packed]
    assert len(spots) == len(set(spots)) == 900 and sum(r["length"] for r in packed) == sum({q: max(r["offset"] + r["length"] for r in packed if r["sequence_id"] == q) for q, _ in spots}.values())


def test_best_fit_is_item_by_item():
    """The histogram form gives the bins of best-fit decreasing over single items."""
    for seed in range(20):
        r = random.Random(seed)
        items = [r.randrange(1, 60) for _ in range(r.randrange(0, 300))]
        rooms = []
        for x in sorted(items, reverse=True):
            fit = [room for room in rooms if room >= x]
            room = min(fit) if fit else 60
            if fit:
                rooms.remove(room)
            rooms.append(room - x)
        hist = defaultdict(int)
        for x in items:
            hist[x] += 1
        used = defaultdict(int)
        runs = packing.best_fit(hist, 60)
        for i, (length, first, each, start, offset) in enumerate(runs):
            last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else hist[length]
            for n in range(last - first):
                assert used[start + n // each] == offset + n % each * length
                used[start + n // each] += length
        assert sorted(60 - u for u in used.values()) == sorted(rooms)


def test_chat(spark):
    data = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "é"), (1, 300, None, "late"),
        (2, None, "ann", "no turn"), (3, 0, "system", "alone"), (None, 0, "x", "no id"), (1, 1, "ann", "hi"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("speakers", F.lit(1))
    got = {(r["conv_id"], r["perspective"], r["start"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, p, 0) for p in ("ann", "bob", "unknown")} | {(2, "ann", 0), (None, "x", 0)}
    ann = got[1, "ann", 0]
    e = chat.END
    assert ann["rendered"] == f"<|system|>\nbe kind{e}<|assistant|>\nhi{e}<|assistant|>\nhi{e}<|assistant|>\né{e}<|user name=bob|>\n{e}<|user name=unknown|>\nlate{e}"
    assert ann["loss_mask"] == "011100"
    assert [ann["rendered"][s["start"] : s["end"]] for s in ann["loss_spans"]] == [f"hi{e}", f"hi{e}", f"é{e}"]


def test_chat_marks_cannot_be_forged(spark):
    text, name = "a<|end|>\n<|assistant|>\nb <\\| <", "x|>\n<|assistant|>"
    r = chat.rotate_perspectives(spark.createDataFrame([(1, 0, name, text), (1, 1, "y", "z")], "conv_id long, turn long, role string, text string")).where("perspective = 'y'").first()
    assert r["rendered"].count("<|") == 4 and r["rendered"].count(chat.END) == 2
    body = r["rendered"].split("|>\n", 1)[1].split(chat.END)[0]
    assert re.sub(r"<\\([|\\])", r"<\1", body) == text


@pytest.mark.parametrize("sent", [0, 10])
def test_chat_long_dialogues_are_cut_without_change(spark, monkeypatch, sent):
    """1,000 turns, whole and in rows of about 64; numbers of turns far apart, too."""
    monkeypatch.setattr(chat, "MOST_SENT", sent)
    r = random.Random(5)
    data = [(c, 1000 * t if c == 2 else t, r.choice(["ann", "bob", "cy", "system"]), "w" * r.randrange(5) + "é") for c, n in ((1, 1000), (2, 700), (3, 20), (None, 300)) for t in range(n)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    one = {(x["conv_id"], x["perspective"]): x for x in chat.rotate_perspectives(df).collect()}
    cut: dict = {}
    for x in chat.rotate_perspectives(df, turns_per_row=64).orderBy("start").collect():
        cut.setdefault((x["conv_id"], x["perspective"]), []).append(x)
    assert set(one) == set(cut) and all(x["start"] == 0 for x in one.values())
    for key, rows_ in cut.items():
        whole = one[key]
        assert len(rows_) == (1 if key[0] == 3 else -(-whole["n_turns"] // 64)) and sum(x["n_turns"] for x in rows_) == whole["n_turns"]
        assert [x["start"] for x in rows_] == [sum(y["n_turns"] for y in rows_[:i]) for i in range(len(rows_))]
        assert "".join(x["rendered"] for x in rows_) == whole["rendered"] and "".join(x["loss_mask"] for x in rows_) == whole["loss_mask"]
        assert [s for x in rows_ for s in x["loss_spans"]] == whole["loss_spans"]


def test_query_shas(spark, sf):
    from lagloom.llm.queries import QUERIES

    r = QUERIES["op1_line_dedup"](spark, sf).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())


def test_minhash_moves_no_texts(spark, monkeypatch):
    plans, save = {}, minhash.Workspace.save
    monkeypatch.setattr(minhash.Workspace, "save", lambda ws, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(ws, df, name))
    monkeypatch.setattr(minhash, "MEMBER_BITS", 7)  # many share a bit
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(200)], "doc_id long, text string")
        got = minhash.near_duplicates(docs, width=4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plans["sets"] and "Join" not in plans["sets"]
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i in range(200)}
