"""Token counts by a map-side lookup in two tiers.

Tier one is a broadcast table of the lengths in tokens of frequent pre-tokens; tier two is a cache in each Python
worker, filled by encoding what the first tier misses. No pre-token is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame

from trendloom.llm.common import hash_sample, id_text, map_texts, worker_state

#: Tasks that count the pre-tokens of the sample; each sends the counts of its most frequent ones to the driver.
SAMPLE_TASKS = 8


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_pattern(tokenizer):
    """Matches the added tokens, which the library finds in texts before anything else; None if there are none."""
    names = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, names))) if names else None


class PreTokenCounter:
    """Counts the tokens of texts for a byte-level BPE tokenizer whose pre-tokens are the matches of `pattern`."""

    def __init__(self, path: str, pattern: str, table: dict[str, int], cache: int = 300_000):
        self.tokenizer = load_tokenizer(path)
        self.split, self.special = regex.compile(pattern), special_pattern(self.tokenizer)
        self.first, self.cache, self.room = table, {}, cache  # tier one, tier two and its bound

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def count_plain(self, text: str) -> int:
        """Of a text without added tokens."""
        pieces = self.split.findall(text)
        total, first, second, missed = 0, self.first.get, self.cache.get, []
        for p in pieces:
            n = first(p)
            if n is None:
                n = second(p)
                if n is None:
                    missed.append(p)
                    continue
            total += n
        if missed:
            new = list(dict.fromkeys(missed))
            found = dict(zip(new, self.lengths(new)))
            total += sum(map(found.__getitem__, missed))
            if len(self.cache) + len(found) > self.room:
                self.cache.clear()
            if len(found) <= self.room:
                self.cache.update(found)
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        return sum(map(self.count_plain, self.special.split(text))) + len(self.special.findall(text))


def frequent_lengths(docs: DataFrame, path: str, pattern: str, sample_docs: int = 2_000, size: int = 50_000) -> tuple[str, np.ndarray]:
    """The table for tier one, of the most frequent pre-tokens in about `sample_docs` documents: names joined by NUL, and lengths.

    The sampled texts are dealt to SAMPLE_TASKS tasks, each of which counts its own and sends its `size` most frequent, so one
    job gives a bounded answer whatever the number of partitions, and no pre-token is shuffled. The table changes the speed
    only, never a count, so a sample is enough; `size` bounds the broadcast.
    """

    def make():
        split = regex.compile(pattern)

        def count(ids, texts):
            top = Counter()
            for t in texts:
                top.update(split.findall(t or ""))
            top = top.most_common(size)
            return {"piece": [p for p, _ in top], "n": [n for _, n in top]}

        return count

    texts = hash_sample(docs.select("doc_id", "text"), sample_docs, salt=3).repartition(SAMPLE_TASKS)
    found = Counter()
    for piece, n in map_texts(texts, "piece string, n long", make, rows=1 << 30).collect():
        found[piece] += n
    names = [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size] if "\0" not in p]
    return "\0".join(names), np.array(PreTokenCounter(path, pattern, {}).lengths(names), np.int32)


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, as the tokenizers library counts without a template.

    `pattern` must be the tokenizer's own pre-token pattern. A null or empty text has 0 bytes and 0 tokens. Strings of
    added tokens inside a text count as one token each, the library's default. Repeated rows give repeated results, an
    empty table none; a null id stays null. Other columns are not read. The file has to be at the same path on every
    executor.
    """
    rows = id_text(docs, id_col, text_col)
    table = frequent_lengths(rows, tokenizer_path, pattern)
    shared, owner = docs.sparkSession.sparkContext.broadcast(table), ("token-lengths", tokenizer_path, pattern, zlib.crc32(table[0].encode()))

    def counter_of_worker():
        names, lengths = shared.value
        return PreTokenCounter(tokenizer_path, pattern, dict(zip(names.split("\0"), lengths.tolist())) if len(lengths) else {})

    def make():
        counter = worker_state(owner, "counter", counter_of_worker)  # later tasks find both tiers filled

        def apply(ids, texts):
            texts = [t or "" for t in texts]
            tokens = [counter.count(t) for t in texts]
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return apply

    return map_texts(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
