"""Language identification by word-first backoff.

A known word adds its log frequency in each language. A word that is not known falls back to the mean over its
known character n-grams of the longest order that has any, down to single characters; a word without any known
character adds nothing. The language with the highest mean over the words wins.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import crc_residue, hash_sample, id_text, keep_rows, letter_runs, map_texts, worker_state
from trendloom.session import Workspace

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """languages: sorted. words, grams: rows of the matrices, which hold a log frequency for each language."""

    languages: list[str]
    words: list[str] = field(default_factory=list)
    word_scores: np.ndarray | None = None
    grams: list[str] = field(default_factory=list)
    gram_scores: np.ndarray | None = None
    max_n: int = 5


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over rows (lang, text); counted within each batch before the shuffle."""

    def make():
        def count(langs, texts):
            found = defaultdict(Counter)
            for lang, text in zip(langs, texts):
                found[lang].update(letter_runs(text or ""))
            flat = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
            return dict(zip(("lang", "word", "n"), map(list, zip(*flat)))) if flat else {"lang": [], "word": [], "n": []}

        return count

    partial = map_texts(rows, "lang string, word string, n long", make, rows=8192)
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, max_n: int) -> DataFrame:
    """(lang, size, gram, n) over the n-grams of words (lang, word, n), of one to max_n characters, a space on either side."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    sizes = words.select("lang", "n", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("size")).filter(F.length("w") >= F.col("size"))
    starts = F.explode(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1)).alias("at")
    grams = sizes.select("lang", "n", "size", "w", starts).select("lang", "size", F.expr("substring(w, at, size)").alias("gram"), "n")
    return grams.filter("trim(gram) != ''").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, name: str, most: int) -> DataFrame:
    """The `most` most frequent of each language; counts are of a bounded sample."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))).filter(F.col("place") <= most).drop("place")


def log_frequencies(counts: dict[str, np.ndarray], totals: np.ndarray) -> np.ndarray:
    """Of each key in each language, with half a count for what was not seen."""
    table = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), len(totals))
    return np.log((table + 0.5) / (totals + 0.5 * max(1, len(counts)))).astype(np.float32)


def by_name(rows, at: dict[str, int], name: str) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(at)))
    for r in rows:
        out[r[name]][at[r.lang]] += r.n
    return dict(sorted(out.items()))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    docs_a_language: int = 5_000, words_a_language: int = 25_000, grams_a_language: int = 25_000, max_n: int = 5) -> LanguageModel:
    """Learns from every row with a text and a language, or from about `docs_a_language` of each language picked by a hash.

    Of each language the `words_a_language` most frequent words are kept, and of the n-grams of those words the
    `grams_a_language` most frequent, so a small language keeps its own words, and the model that is broadcast is bounded by
    the number of languages. Without labelled rows the model knows no language.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    with Workspace(docs.sparkSession, "language") as space:
        words = space.written(most_frequent(word_counts(hash_sample(known, docs_a_language, salt=2, by="lang")), "word", words_a_language), "words")
        grams = space.written(gram_counts(words, max_n), "grams")
        chosen, kept = most_frequent(grams, "gram", grams_a_language).collect(), words.collect()  # bounded a language
        totals = grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in kept})
    at = {x: i for i, x in enumerate(languages)}
    counts, gram_names, gram_rows = by_name(kept, at, "word"), [], [np.zeros((0, len(languages)), np.float32)]
    for size in range(1, max_n + 1):
        own = by_name([r for r in chosen if r["size"] == size], at, "gram")
        gram_names += own
        gram_rows.append(log_frequencies(own, by_name([r for r in totals if r["size"] == size], at, "size").get(size, np.zeros(len(languages)))))
    return LanguageModel(languages, list(counts), log_frequencies(counts, sum(counts.values(), np.zeros(len(languages)))), gram_names, np.concatenate(gram_rows), max_n)


class Scorer:
    """Scores texts in a task. Unseen words are kept in a bounded cache beside the known ones."""

    def __init__(self, model: LanguageModel, cache: int = 100_000):
        self.model, self.known = model, {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i for i, g in enumerate(model.grams)}
        self.base, self.room = len(model.words), cache
        self.table = np.zeros((self.base + cache, len(model.languages)), np.float32)
        if self.base:
            self.table[: self.base] = model.word_scores
        self.rows = dict(self.known)

    def backoff(self, word: str) -> np.ndarray | None:
        padded = f" {word} "
        for order in range(min(self.model.max_n, len(padded)), 0, -1):
            found = [i for k in range(len(padded) - order + 1) if (i := self.grams.get(padded[k : k + order])) is not None]
            if found:
                return self.model.gram_scores[found].mean(axis=0)
        return None

    def row(self, word: str) -> int:
        """Where the scores of a word that is not in self.rows now stand."""
        if len(self.rows) >= self.base + self.room:
            self.rows = dict(self.known)
        at = self.rows[word] = len(self.rows)
        score = self.backoff(word)
        self.table[at] = 0 if score is None else score
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        words = letter_runs(text or "")
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        total, start = np.zeros(len(self.model.languages)), 0
        for start in range(0, len(words), 20_000):  # less than the cache holds, so no row is replaced before it is read
            part = words[start : start + 20_000]
            if len(self.rows) + len(part) > self.base + self.room:
                self.rows = dict(self.known)
            get = self.rows.get
            ids = [i if (i := get(w)) is not None else self.row(w) for w in part]
            total += self.table[ids].sum(axis=0)
        best = int(total.argmax())
        margin = (total - total[best]) * (min(len(words), 50) / len(words))
        return self.model.languages[best], float(1 / np.exp(margin).sum())


def scorer_maker(docs: DataFrame, model: LanguageModel):
    """Gives each worker one scorer of the model, which it keeps until it is asked for another."""
    shared, owner = docs.sparkSession.sparkContext.broadcast(model), ("language", hashlib.sha256(pickle.dumps(model)).hexdigest())
    return lambda: worker_state(owner, "scorer", lambda: Scorer(shared.value))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    score: the softmax over languages of the summed evidence, of 50 words at most, so it lies between 0 and 1. A null
    text and a text without a letter give `und` and 0; so does a model without languages. Ties go to the language
    that sorts first. Repeated rows give repeated results; an empty table gives none; a null id stays null. Other
    columns are not read.
    """
    scorer = scorer_maker(docs, model)

    def make():
        score = scorer().score

        def apply(ids, texts):
            found = [score(t) for t in texts]
            return {"doc_id": ids, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return apply

    return map_texts(id_text(docs, id_col, text_col), "doc_id long, lang_pred string, score double", make)


def keep_known_languages(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose language can be told with a score from least_score on, all columns; each row by its own text."""
    scorer = scorer_maker(docs, model)

    def make():
        score = scorer().score
        return lambda texts: [x[0] != UNDETERMINED and x[1] >= least_score for x in map(score, texts)]

    return keep_rows(docs, make, text_col)


def learn_outside_fold(docs: DataFrame, folds: int = 5) -> LanguageModel:
    return learn_languages(docs.filter(crc_residue(F.col("doc_id"), folds) != 0))


def predict_all(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the documents outside fold 0 and predicts all; adds held_out, true in fold 0 (false for a null id)."""
    held_out = F.coalesce(crc_residue(F.col("doc_id"), folds) == 0, F.lit(False))
    return identify_language(docs, learn_outside_fold(docs, folds)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_language(spark, sf_dir: str) -> DataFrame:
    return predict_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))
