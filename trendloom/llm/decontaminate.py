"""Benchmark decontamination by MinHash containment search over size partitions.

A text contains an item if it holds a share of `threshold` or more of the item's distinct word shingles. Items are
partitioned by size, a class for each power of two of their number of shingles. An item of q shingles can lose
q - ceil(threshold q) of them, so of its smallest q - ceil(threshold q) + 1 shingle hashes (its MinHash sketch) a containing
text holds at least one. The greatest hash in the sketches of a class bounds the class: of a text, however long, only the
hashes up to that bound, the text's own sketch for the class, are looked up in the class's index. Each hit is verified by
exact shingles, so no containing pair is missed, and none is reported that is not.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import ALNUM, id_text, keep_rows, map_texts, worker_state
from trendloom.llm.shingles import ShingleHasher
from trendloom.session import Workspace

PAIR_SCHEMA = "doc_id long, item long, n_item_shingles long, n_shared long, containment double"
_TABLE_BITS = 20


def exact_shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*[words[i:] for i in range(k)]))


def item_words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").lower())


class SizeClass:
    """The index of the items of one shingle width and size class: sketch hashes in order, and the item of each."""

    def __init__(self, hashes: np.ndarray, owners: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.bound = self.hashes[-1]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def candidates(self, runs: np.ndarray) -> np.ndarray:
        """Items with a sketch hash among the text's hashes up to the bound."""
        sketch = runs[runs <= self.bound]
        sketch = np.unique(sketch[self.table[sketch >> np.uint64(64 - _TABLE_BITS)]])
        start, end = np.searchsorted(self.hashes, sketch, "left"), np.searchsorted(self.hashes, sketch, "right")
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(start[end > start], end[end > start])] or [np.empty(0, np.int64)]))


class SketchIndex:
    """The items of one block, (item, words joined by a space). Items of fewer than `width` words are a single shingle."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold, self.hasher, self.items = threshold, ShingleHasher(), []
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, joined in items:
            words = joined.split(" ")
            k = min(width, len(words))
            hashes = np.unique(self.hasher.runs(self.hasher.words(words), k))
            sketch = hashes[: len(hashes) - math.ceil(threshold * len(hashes) - 1e-9) + 1]
            sketches[k, len(hashes).bit_length()].append((sketch, len(self.items)))
            self.items.append((item, k, joined))
        self.classes = {key: SizeClass(np.concatenate([s for s, _ in own]), np.repeat([i for _, i in own], [len(s) for s, _ in own]))
                        for key, own in sorted(sketches.items())}

    def search(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item, shingles of the item, shared shingles) of each item that the text contains, or of one of them."""
        words = item_words(text)
        hashes, found, runs, own = self.hasher.words(words), [], {}, {}
        for (k, _), index in self.classes.items():
            if k not in runs:
                runs[k] = self.hasher.runs(hashes, k)
            for i in index.candidates(runs[k]).tolist():
                if k not in own:
                    own[k] = exact_shingles(words, k)
                item, _, joined = self.items[i]
                shingles = exact_shingles(joined.split(" "), k)
                shared = len(shingles & own[k])
                if shared >= self.threshold * len(shingles) - 1e-9:
                    found.append((item, len(shingles), shared))
                    if first_only:
                        return found
        return found


def distinct_items(items: DataFrame, item_id_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, words) of the distinct word sequences of all items, and (item, item_id) of every row with a word."""
    own = items.select(items[item_id_col].cast("long").alias("doc_id"), items[item_text_col].cast("string").alias("text"))
    make = lambda: lambda ids, texts: {"item_id": ids, "words": [" ".join(item_words(t)) for t in texts]}
    rows = map_texts(own, "item_id long, words string", make).filter("words != ''").withColumn("item", F.xxhash64("words"))
    return rows.groupBy("item").agg(F.min("words").alias("words")), rows.select("item", "item_id")


def item_blocks(spark, distinct: DataFrame, block_items: int, block_bytes: int) -> list:
    """Broadcasts of the items in blocks of about block_items rows and block_bytes characters at most; the sizes are counted
    before anything is sent, and the blocks doubled until each is in bounds or one item by itself."""
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item", F.lit(blocks)), F.lit(blocks))
        largest = distinct.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("size")).agg(
            F.max(F.when(F.col("n") > 1, F.greatest(F.col("n") / block_items, F.col("size") / block_bytes)))).first()[0]
        if largest is None or largest <= 1.5:
            break
        blocks *= 2
    out = []
    for b in range(blocks):
        rows = sorted((r.item, r.words) for r in distinct.filter(block == b).collect())  # bounded by the block
        if rows:
            out.append((spark.sparkContext.broadcast(rows), hashlib.sha256(repr(rows).encode()).hexdigest()))
    return out


def index_of_worker(block, width: int, threshold: float):
    """Gives each worker one index of the block, which later tasks find made."""
    shared, digest = block
    return lambda: worker_state(("items", digest, width, threshold), "index", lambda: SketchIndex(shared.value, width, threshold))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", block_items: int = 100_000, block_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for each text and each item that it contains.

    Words are runs of letters and digits, lower-cased. A null text, a text without words and an item without words
    match nothing; an item of fewer than `width` words matches where its words stand in a row. Repeated rows give
    repeated pairs; an empty table on either side gives none. Other columns are not read. Items of equal words are searched
    once and joined to their ids after. Distinct items are taken in blocks of about block_items rows and block_bytes
    characters, each of which is one broadcast and one pass over the texts; an item longer than that is a block of its own.
    """
    spark = docs.sparkSession
    distinct, ids = distinct_items(items, item_id_col, item_text_col)
    texts, found = id_text(docs, id_col, text_col), spark.createDataFrame([], PAIR_SCHEMA)
    with Workspace(spark, "items") as space:  # the blocks are with the tasks before it goes
        blocks = item_blocks(spark, space.written(distinct, "distinct"), block_items, block_bytes)
    for block in blocks:

        def make(index_of=index_of_worker(block, width, threshold)):
            index = index_of()

            def apply(ids, texts):
                flat = [(i, item, q, s, s / q) for i, t in zip(ids, texts) for item, q, s in index.search(t)]
                names = ("doc_id", "item", "n_item_shingles", "n_shared", "containment")
                return dict(zip(names, map(list, zip(*flat)))) if flat else {x: [] for x in names}

            return apply

        found = found.unionByName(map_texts(texts, PAIR_SCHEMA, make))
    return found.join(ids, "item").select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", block_items: int = 100_000, block_bytes: int = 32_000_000) -> DataFrame:
    """The rows whose text contains no item, all columns; each row by its own text.

    One block of items, the usual case, is one pass that drops rows where they are read. More blocks are a pass each that tells
    the digests of the texts to drop, whose rows one join then takes out; the texts are never written again, and a worker
    holds one index at a time.
    """
    spark = docs.sparkSession
    distinct, _ = distinct_items(items, item_id_col, item_text_col)
    with Workspace(spark, "items") as space:
        blocks = item_blocks(spark, space.written(distinct, "distinct"), block_items, block_bytes)
    bad = []
    for block in blocks:

        def holds(index_of=index_of_worker(block, width, threshold)):
            index = index_of()
            return lambda texts: [index.search(t, first_only=True) for t in texts]

        if len(blocks) == 1:
            return keep_rows(docs, lambda holds=holds: (lambda texts, find=holds(): [not x for x in find(texts)]), text_col)

        def digests(holds=holds):
            find = holds()
            return lambda ids, texts: {"digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t, x in zip(texts, find(texts)) if x]}

        bad.append(map_texts(docs.select(F.lit(None).cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), "digest binary", digests))
    if not bad:
        return docs
    return docs.join(reduce(DataFrame.unionByName, bad).distinct(), F.unhex(F.sha2(docs[text_col], 256)) == F.col("digest"), "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.round("containment", 6))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
q AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
short AS (SELECT d.doc_id, b.item_id FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4
          AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, round(shared / n, 6) AS containment
FROM m JOIN q USING (item_id) WHERE shared >= 0.8 * n - 1e-9
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM short
"""
