"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, mix64

#: Letters only: words of whatever script.
WORD = re.compile(r"[^\W\d_]+").findall
LONGEST = 5
#: Bounds of the fit, all parameters of ``train`` and all for each language: labelled documents, words, n-grams.
DOCS_PER_LANGUAGE, WORDS, GRAMS = 1000, 30_000, 30_000
#: More labels than this aren't languages: an error.
MOST_LABELS = 10_000
#: Bytes of words and their scores that a task keeps, and what a word takes besides its scores, about.
CACHE, WORD_BYTES = 24 << 20, 200
TOGETHER = 64


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _counted(batches):
    import pyarrow as pa

    for batch in batches:
        by: dict[str, tuple[Counter, Counter]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, parts = by.setdefault(lang, (Counter(), Counter()))
            words.update(WORD((text or "").lower()))
        for words, parts in by.values():
            for w, c in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        parts[g] += c
        rows = [(lang, kind, g, c) for lang, both in by.items() for kind, counts in enumerate(both) for g, c in counts.items()]
        cols = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "kind", "gram", "n"])


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def wider(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those without their last character, and that character."""
    return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(1))


def gram_keys(parts: list[str]) -> np.ndarray:
    """Keys of n-grams of one length."""
    points = code_points(parts).reshape(len(parts), -1)
    keys = np.zeros(len(parts), np.uint64)
    for j in range(points.shape[1]):
        keys = wider(keys, points[:, j])
    return keys


class Gains:
    """Key -> what it adds to the log score of each language that has it; sorted keys, sparse rows."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray):
        order = np.lexsort((langs, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.starts = np.append(first, len(order))
        self.langs, self.gains = langs[order].astype(np.int32), np.log(2.0 * counts[order] + 1).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 for those that aren't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, scores: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Adds the gains of places ``at`` to ``scores[rows]``; no row twice."""
        n = self.starts[at + 1] - self.starts[at]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.starts[at], n)
        scores[np.repeat(rows, n), self.langs[flat]] += self.gains[flat]


class Model:
    """Per-language log frequencies of words, and of character n-grams for words it has not seen.

    A count c in a language scores log((c + 1/2) / total): what c = 0 scores is the same for all words
    (``base``), and only languages that have a word hold a gain over it. So the tables grow with what
    each language has, not with words times languages.
    """

    def __init__(self, langs: list[str], words: Gains, parts: Gains, word_base: np.ndarray, part_base: np.ndarray):
        self.langs, self.words, self.parts = langs, words, parts
        self.word_base, self.part_base = word_base, part_base
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "held")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    @classmethod
    def fit(cls, rows: list[tuple[str, int, str, int]], langs: list[str]) -> "Model":
        """From (lang, 0 for words or 1 for n-grams, text, count)."""
        at = {x: i for i, x in enumerate(langs)}
        by: dict[int, list] = {}
        for lang, kind, text, n in rows:
            by.setdefault(len(text) if kind else 0, []).append((text, at[lang], n))
        hashed = [(size, (word_keys if not size else gram_keys)([r[0] for r in found]), [r[1] for r in found], [r[2] for r in found]) for size, found in by.items()]
        columns = [np.repeat([h[0] for h in hashed], [len(h[1]) for h in hashed])]
        columns += [np.concatenate([np.asarray(h[i], kind) for h in hashed]) if hashed else np.empty(0, kind) for i, kind in ((1, np.uint64), (2, np.int64), (3, np.int64))]
        return cls.of(langs, *columns)

    @classmethod
    def of(cls, langs: list[str], size: np.ndarray, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> "Model":
        """From hashed entries; ``size`` 0 marks words, others are lengths of n-grams."""
        total = lambda here: np.bincount(at[here], weights=n[here], minlength=len(langs)) + 0.5 * (len(np.unique(keys[here])) + 1)
        word, base = size == 0, np.full((LONGEST + 1, len(langs)), np.log(0.5))
        for k in range(1, LONGEST + 1):
            if (size == k).any():
                base[k] = np.log(0.5 / total(size == k))
        return cls(langs, Gains(keys[word], at[word], n[word]), Gains(keys[~word], at[~word], n[~word]), np.log(0.5 / total(word)), base)

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: each covered from its start by the longest n-grams that are known."""
        out = np.zeros((len(words), len(self.langs)))
        points = code_points([f"<{w}>" for w in words])
        ends = np.cumsum([len(w) + 2 for w in words])
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(points))
        longest, place = np.zeros(len(points), np.int64), np.full(len(points), -1)
        keys = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            keys = wider(keys[: len(points) - n + 1], points[n - 1 :])
            here = np.flatnonzero(left[: len(keys)] >= n)
            found = self.parts.find(keys[here])
            known = here[found >= 0]
            longest[known], place[known] = n, found[found >= 0]
        at, rows = ends - np.diff(ends, prepend=0), np.arange(len(words))
        while len(rows):
            n, where = longest[at], place[at]
            out[rows] += self.part_base[np.maximum(n, 1)]
            self.parts.add(out, rows[n > 0], where[n > 0])
            at = at + np.maximum(n, 1)
            going = at < ends[rows]
            at, rows = at[going], rows[going]
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of words in each language."""
        out = np.repeat(self.word_base[None], len(words), axis=0)
        at = self.words.find(word_keys(words))
        self.words.add(out, np.flatnonzero(at >= 0), at[at >= 0])
        if len(unseen := np.flatnonzero(at < 0)):
            out[unseen] = self.backoff([words[i] for i in unseen.tolist()])
        return out

    def _learn(self, words: set[str]) -> None:
        """Keeps the scores of words, each scored once as long as it is kept."""
        new = [w for w in words if w not in self.place]
        if not new:
            return
        if (len(self.place) + len(new)) * (8 * len(self.langs) + WORD_BYTES) > CACHE:
            self.forget()
            new = list(words)
        if (need := len(self.place) + len(new)) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros((max(need, 2 * len(self.held)) - len(self.held), len(self.langs)))])
        start = len(self.place)
        self.held[start:need] = self.scores(new)
        self.place.update(zip(new, range(start, need)))

    def predict_many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text."""
        out = []
        for start in range(0, len(texts), TOGETHER):
            split = [WORD(t.lower()) if t and self.langs else [] for t in texts[start : start + TOGETHER]]
            self._learn({w for words in split for w in words})
            for words in split:
                if not any(any(map(str.isalpha, w)) for w in words):
                    out.append(("und", 0.0))
                    continue
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                # long texts in parts, so that the rows taken stay few
                total = sum(self.held[at[i : i + 8192]].sum(axis=0) for i in range(0, len(at), 8192))
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_many([text])[0]


def _hashed(langs: list[str]):
    """(size, key, lang, n) of ranked entries; size 0 marks words."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, kind, text, n = (batch.column(i).to_pylist() for i in range(4))
            size = np.array([len(t) if k else 0 for k, t in zip(kind, text)], np.int32)
            keys = np.empty(len(size), np.uint64)
            for s in np.unique(size).tolist():
                here = np.flatnonzero(size == s)
                keys[here] = (gram_keys if s else word_keys)([text[i] for i in here.tolist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(size), pa.array(keys.view(np.int64)), pa.array([place[x] for x in lang], pa.int32()), pa.array(n, pa.int64())],
                ["size", "key", "lang", "n"],
            )

    return run


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE,
    words: int = WORDS, n_grams: int = GRAMS,
) -> Model:
    """A model fitted on a bounded sample: of each language, the ``docs_per_language`` rows with the
    smallest hash of their id (ties by id); of these whole texts, each language's ``words`` most frequent
    words and ``n_grams`` most frequent n-grams. All languages are learned, and each has tables of its own
    size, however many there are; over ``MOST_LABELS`` distinct labels are an error. Rows with null lang don't count."""
    base = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = base.groupBy("lang").agg(F.count("*").alias("rows"))
    known = sizes.limit(MOST_LABELS + 1).collect()
    if len(known) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} distinct language labels")
    langs = sorted(r["lang"] for r in known)
    if not langs:
        return Model.fit([], [])
    # hashes are uniform: under this share of them a language has about 4 * docs_per_language rows, so that
    # what is ranked doesn't grow with the corpus. MOST_LABELS rows at most
    share = labelled.sparkSession.createDataFrame([(r["lang"], 4 * docs_per_language / r["rows"]) for r in known], "of string, share double")
    first = Window.partitionBy("lang").orderBy("h", "id")
    picked = (
        base.select("id", "lang", F.xxhash64("id").alias("h")).join(F.broadcast(share), F.col("lang") == F.col("of"))
        .where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
        .withColumn("at", F.row_number().over(first)).where(F.col("at") <= docs_per_language)
        .select(F.col("id").alias("picked"), F.col("lang").alias("of")).distinct()
    )
    # docs_per_language * MOST_LABELS pairs at most
    sample = base.join(F.broadcast(picked), F.expr("id <=> picked and lang = of"), "left_semi").select("lang", "text")
    counted = sample.mapInArrow(lean(_counted), "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == 0, words).otherwise(n_grams)).select("lang", "kind", "gram", "n")
    # (words + n_grams) rows of 24 bytes for each language
    table = kept.mapInArrow(lean(_hashed(langs)), "size int, key long, lang int, n long").toArrow()
    size, keys, at, n = (np.asarray(table[c].to_numpy()) for c in ("size", "key", "lang", "n"))
    return Model.of(langs, size, keys.astype(np.int64).view(np.uint64), at.astype(np.int64), n)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred and score (posterior of the predicted language, 0 to 1).

    Known words score by their log frequency in each language; an unseen word is covered by the
    longest known n-grams, shorter ones where longer ones are unknown. A task scores each distinct word
    once as long as it keeps it, and sums rows of scores. Whole texts are read; language
    labels, sources and ids are not. Null text, text without a letter, or a model that has learned
    no language: "und", score 0. Ties go to the language first in order. Null ids, repeated rows and
    clashing columns: one result per row, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    base = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).cast("string").alias("_text"))
    kinds = dict(base.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = sent.value.predict_many(batch.column(len(names)).to_pylist())
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    out = base.mapInArrow(lean(run, lambda: sent.value.forget()), ", ".join([*(f"{n} {kinds[n]}" for n in names), "lang_pred string", "score double"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, for all rows."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(named, model, "text", ("doc_id", "held_out"))
