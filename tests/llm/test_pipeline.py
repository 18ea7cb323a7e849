"""The pipeline against its stages' definitions, and its awkward inputs."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from lagloom.llm.packing import token_bytes
from lagloom.llm.queries import tokenizer_file

from .test_documents import brute_near


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "language_id":
            lettered = [r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"] or "")]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(lettered)
            labels = {r["doc_id"]: r["lang"] for r in before.collect()}
            assert all(r["lang"] and r["lang"] == (labels[r["doc_id"]] or r["lang"]) for r in docs.collect())
        if name == "line_dedup":
            seen, kept = {}, {}
            held = {r["doc_id"]: r["text"].split("\n") for r in before.collect()}
            key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            for d, lines in held.items():
                for x in lines:
                    seen.setdefault(key(x), set()).add(d)
            for d, lines in held.items():
                kept[d] = "\n".join(x for x in lines if len(key(x)) < 10 or min(seen[key(x)]) == d)
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()} == {d: (t, len(t)) for d, t in kept.items()}
        if name == "minhash_dedup":
            want = brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5, 0.8)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, c in want.items() if d == c}
        if name == "packing":
            path = tokenizer_file("word_bpe_49k.json")
            want = sum(len(token_bytes(r["text"] or "", path)) // 4 + 1 for r in before.collect())
            assert docs.agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, lang_pred string"
    for data in ([], [(1, None, None, None, None, "a", "b"), (None, "words", "en", None, 5, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, "more words", "en", "s", 0, "a", "b"), (3, "more words", "en", "s", 0, "a", "b")]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert [c for c, _ in docs.dtypes] == [x.split()[0] for x in schema.split(", ")]
        assert {r["doc_id"] for r in docs.collect()} == ({None, 3} if data else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [(1, "words", None)]
