"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their four-letter beginnings, hashed into a fixed number of buckets. The model adds to
the linear weights a product of latent factors for each pair of terms in a text, so that a pair such as an insult with
a mention of a group can count for more than the sum of its terms.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc_residue, hash_sample, id_text, letter_runs, map_texts, worker_state

BUCKET_BITS = 18


@dataclass
class FactorizationMachine:
    """P(toxic) = sigmoid(bias + sum w + half the sum over factors of (sum v)^2 - sum v^2); sums over a text's distinct buckets."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


class TermHasher:
    """Distinct buckets of a text's terms; words are remembered up to a bound."""

    def __init__(self, bits: int = BUCKET_BITS, cache: int = 300_000):
        self.mask, self.room, self.seen = (1 << bits) - 1, cache, {}

    def buckets(self, text: str | None) -> np.ndarray:
        words = set(letter_runs(text or ""))
        seen, get = self.seen, self.seen.get
        if len(seen) + len(words) > self.room:
            seen.clear()
        flat: list[int] = []
        for w in words:
            pair = get(w)
            if pair is None:
                pair = seen[w] = (zlib.crc32(w.encode()) & self.mask, zlib.crc32(b"^" + w[:4].encode()) & self.mask)
            flat += pair
        return np.unique(np.array(flat, np.int32))


def labelled_buckets(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_id: str, label_col: str):
    """(bucket arrays, labels) of about max_rows labelled documents, in order of the id."""
    own = labels.select(labels[label_id].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    own = own.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = hash_sample(own, max_rows, salt=6)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text an id, however often it is repeated

    def make():
        hasher = TermHasher()

        def apply(keys, texts):
            return {"key": keys, "buckets": [hasher.buckets(t) for t in texts]}

        return apply

    found = map_texts(rows.select(F.concat_ws(" ", "doc_id", "label").alias("key"), "text"), "key string, buckets array<int>", make).toArrow()
    read = sorted((*map(int, key.split()), at) for at, key in enumerate(found["key"].to_pylist()))
    arrays = found["buckets"].to_pylist()
    return [np.array(arrays[at], np.int32) for _, _, at in read], np.array([label for _, label, _ in read], np.float64)


def telling_buckets(rows: list[np.ndarray], labels: np.ndarray, size: int, least_rows: int, least_chi2: float) -> np.ndarray:
    """Which buckets are in at least `least_rows` rows and not independent of the label by a chi-squared test.

    Texts hold far more rare words than toxic ones; without this the machine learns the rare words by heart.
    """
    flat, each = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
    n, toxic = np.bincount(flat, minlength=size).astype(float), np.bincount(flat, each, minlength=size)
    expected = np.maximum(n * labels.mean(), 1e-9)
    chi2 = (toxic - expected) ** 2 * (1 / expected + 1 / np.maximum(n - expected, 1e-9))
    return (n >= least_rows) & (chi2 >= least_chi2)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, size: int, least_rows: int, least_chi2: float, least_share: float = 0.015,
                  step: int = 512) -> np.ndarray:
    """Which buckets are in a pair that is toxic more often, or less often, by a chi-squared test, than each of its two alone;
    whether they tell on their own does not count. A pair toxic more often has to be in `least_rows` toxic rows and in
    `least_share` of them, one less often to miss so many, so that the number of pairs does not grow with the rows."""
    flat, each = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
    n, toxic = np.bincount(flat, minlength=size), np.bincount(flat, each, minlength=size)
    least_rows = max(least_rows, least_share * labels.sum())
    terms, found = np.flatnonzero(toxic >= least_rows), np.zeros(size, bool)
    rate, place = toxic[terms] / n[terms], np.full(size, -1)
    place[terms] = np.arange(len(terms))

    def together(own: list[np.ndarray], start: int, end: int) -> np.ndarray:
        """In how many rows each of terms[start:end] stands with each term from `start` on."""
        counts = np.zeros((end - start, len(terms) - start), np.float32)
        for at in range(0, len(own), step):
            held = np.zeros((min(step, len(own) - at), len(terms) - start), np.float32)
            for i, r in enumerate(own[at : at + step]):
                held[i, place[r][place[r] >= start] - start] = 1
            counts += held[:, : end - start].T @ held
        return counts

    toxic_rows = [r for r, y in zip(rows, labels) if y]
    for start in range(0, len(terms), step):
        end = min(start + step, len(terms))
        both, bad = together(rows, start, end), together(toxic_rows, start, end)
        high, low = (both * f(rate[start:end, None], rate[start:]) for f in (np.maximum, np.minimum))
        more, less = (bad > high + 0.01) & (bad >= least_rows), (bad < low - 0.01) & (low - bad >= least_rows)
        expected = np.maximum(np.where(more, high, low), 1e-9)
        chi2 = (bad - expected) ** 2 * (1 / expected + 1 / np.maximum(both - expected, 1e-9))
        a, b = np.nonzero((more | less) & (chi2 >= least_chi2))
        found[terms[start + a]] = found[terms[start + b]] = True
    return found


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 12, batch: int = 128, rate: float = 0.3,
                decay: float = 1e-5, least_rows: int = 5, least_chi2: float = 10.0, least_pair_chi2: float = 80.0, seed: int = 6, bits: int = BUCKET_BITS) -> FactorizationMachine:
    """Logistic loss by AdaGrad in minibatches; the same rows give the same model. Without both labels it scores everything 0.

    Buckets that tell neither alone nor in a pair stay at 0. With rank 0 the model is linear.
    """
    size, rng = 1 << bits, np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, rank))
    if not len(rows) or labels.min() == labels.max():
        return FactorizationMachine(-20.0, w.astype(np.float32), np.zeros((size, rank), np.float32))
    once = sorted({(r.tobytes(), y): i for i, (r, y) in enumerate(zip(rows, labels))}.values())  # all pairs of a text that has copies would tell
    telling = telling_buckets(rows, labels, size, least_rows, least_chi2) | telling_pairs([rows[i] for i in once], labels[once], size, least_rows, least_pair_chi2)
    rows = [r[telling[r]] for r in rows]
    v[~telling] = 0
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            own = order[start : start + batch]
            counts = np.array([len(rows[i]) for i in own])
            flat = np.concatenate([rows[i] for i in own])
            doc = np.repeat(np.arange(len(own)), counts)
            terms, at = np.unique(flat, return_inverse=True)
            vt = v[terms]
            sums = np.array([np.bincount(doc, vt[at, f], len(own)) for f in range(rank)]).reshape(rank, len(own)).T
            squares = np.bincount(doc, (vt**2).sum(1)[at], len(own))
            z = bias + np.bincount(doc, w[terms][at], len(own)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            gd = g[doc]
            gw = np.bincount(at, gd, len(terms)) + decay * w[terms]
            gv = np.array([np.bincount(at, gd * sums[doc, f], len(terms)) for f in range(rank)]).reshape(rank, len(terms)).T - vt * np.bincount(at, gd, len(terms))[:, None] + decay * vt
            seen_w[terms] += gw**2
            seen_v[terms] += gv**2
            seen_b += g.sum() ** 2
            w[terms] -= rate * gw / np.sqrt(seen_w[terms])
            v[terms] -= 0.2 * rate * gv / np.sqrt(seen_v[terms])
            bias -= rate * g.sum() / np.sqrt(seen_b)
    return FactorizationMachine(bias, w.astype(np.float32), v.astype(np.float32))


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text",
                   label_id: str = "doc_id", label_col: str = "toxic") -> FactorizationMachine:
    """Fits on about max_rows labelled rows picked by a hash of the id (all, if fewer). Rows with a null id or a label other
    than 0 and 1 are left out; a repeated id counts once, as toxic if any of its labels is, and with the first of its texts
    in order."""
    return fit_machine(*labelled_buckets(docs, labels, max_rows, id_col, text_col, label_id, label_col))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; score between 0 and 1, predicted 1 from `threshold` on.

    An empty or null text gets the model's bias. Repeated rows give repeated results, an empty table none; a null id
    stays null. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, hasher = shared.value, worker_state("toxicity", "hasher", TermHasher)

        def one(text):
            ids = hasher.buckets(text)
            v = m.factors[ids]
            z = m.bias + float(m.weights[ids].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        def apply(ids, texts):
            scores = [one(t) for t in texts]
            return {"doc_id": ids, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return apply

    return map_texts(id_text(docs, id_col, text_col), "doc_id long, score double, predicted int", make)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_toxicity(docs, labels.filter(crc_residue(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(crc_residue(F.col("doc_id"), 3) == 1, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
