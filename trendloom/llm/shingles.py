"""Hashes of word shingles, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from trendloom.llm.common import worker_state

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class ShingleHasher:
    """64-bit hashes of runs of words, the same in every process. Words are remembered up to a bound."""

    def __init__(self, cache: int = 100_000):
        self.seen, self.room = {}, cache

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > self.room:
            self.seen.clear()
        get, seen, out = self.seen.get, self.seen, []
        for w in words:
            h = get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def runs(hashes: np.ndarray, k: int) -> np.ndarray:
        """Of each run of k words, in order; none if there are fewer words."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = hashes[:n].copy()
        for i in range(1, k):
            h = h * _STEP + hashes[i : n + i]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def worker_hasher() -> ShingleHasher:
    """One for each worker process, so that later tasks know the words already."""
    return worker_state("shingles", "hasher", ShingleHasher)
