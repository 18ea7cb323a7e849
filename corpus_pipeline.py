"""Corpus preparation in four stages: language ID, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import language_id, line_dedup, minhash, packing
from lagloom.llm.common import Workspace
from lagloom.llm.queries import tokenizer_file


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator uses, and their own names -> these."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null text, or no letter) and gives a language to those without a label.

    Learns from the labelled rows. A null ``lang`` becomes the predicted one; labels that are there stay. Without any labelled
    row nothing is learned: documents with a letter are kept as they are. Null ids, repeated and long texts: as any other;
    ties go to the language first in order. An empty table gives an empty result.
    """
    plain, names = numbered(docs)
    model = language_id.train(docs)
    out = language_id.identify(plain, model, names["text"], tuple(plain.columns))
    if not model.langs:
        return out.where(F.col(names["text"]).rlike(r"\p{L}")).select(*(F.col(n).alias(c) for c, n in names.items()))
    new = {"lang": F.coalesce(names["lang"], "lang_pred")}
    return out.where("lang_pred <> 'und'").select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows.

    A line stays in the smallest id that holds it. Null texts become empty; rows with a null id keep their lines, rows that
    share an id never drop each other's. All rows stay, also where no line is left. An empty table gives an empty result.
    """
    plain, names = numbered(docs)
    own = tuple(n for c, n in names.items() if c not in ("doc_id", "text"))
    out = line_dedup.dedup_lines(plain, names["doc_id"], names["text"], carry=own)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    kinds = dict(docs.dtypes)
    return out.select(*(new.get(c, F.col(n)).cast(kinds[c]).alias(c) for c, n in names.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates: five words, similarity 0.8.

    Texts without words are near nothing and stay, as do rows with a null id; rows that share an id stay or go together.
    An empty table gives an empty result.
    """
    found = minhash.near_duplicates(docs, width=5, similarity=0.8)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, best fit decreasing.

    Null and empty texts are one end id each; null ids and repeated rows are documents each; only longer documents are cut.
    An empty table gives an empty result.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Tokenisation and packing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
