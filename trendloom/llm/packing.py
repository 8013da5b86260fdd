"""Best-fit packing of documents into sequences of a fixed number of tokens, improved by local search.

Tasks encode texts into pieces that fit in a sequence. Pieces shorter than a sequence are dealt to tasks of bounded size, each
of which places them best fit, longest first, and then empties sequences by exchanges: it moves a piece, or exchanges
one for one, two for one or one for two, between underfull sequences wherever that increases the sum of squared fills.
The emptiest sequences of all tasks are dealt out again, to fewer tasks, until one task is left.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import UNCOMMON, give_back_memory, id_text, worker_state
from trendloom.llm.token_counts import load_tokenizer, special_pattern
from trendloom.llm.token_files import byte_letters
from trendloom.session import Workspace

#: Pieces that a task packs, on average.
TASK_PIECES = 16_000
#: The part of a task's pieces whose sequences are dealt out again.
REOPENED = 0.25


class PieceIds(dict):
    """Ids of pre-tokens as bytes of unsigned 32-bit numbers, merged by the library's model when missing. A full table becomes
    an older one, whose entries come back when used."""

    def __init__(self, model, room: int):
        self.model, self.room, self.older, self.letters = model, room, {}, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            named = piece.encode().decode("latin-1").translate(self.letters)
            made = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        self[piece] = made
        return made


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them without a template, as bytes of unsigned 32-bit numbers.

    For a byte-level BPE file each pre-token is looked up by itself; strings of added tokens go before anything else, as in the
    library. Files of another kind are left to the library, text by text.
    """

    #: Fixed value: the pre-token pattern of byte-level tokenizer files.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: That pattern as it reads in texts of common characters.
    COMMON_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str, cache: int = 300_000):
        self.tokenizer = load_tokenizer(path)
        self.special, self.pieces = special_pattern(self.tokenizer), PieceIds(self.tokenizer.model, cache)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_pieces = (made.get("normalizer") is None and made["model"]["type"] == "BPE" and not made["model"].get("ignore_merges")
                          and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
                          and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens") or []))

    def plain(self, text: str) -> bytes:
        """Of a text without added tokens."""
        return b"".join(map(self.pieces.__getitem__, (self.SPLIT if UNCOMMON.search(text) else self.COMMON_SPLIT).findall(text)))

    def encode(self, text: str) -> bytes:
        if not self.by_pieces:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), array("I", [self.tokenizer.token_to_id(m[0])]).tobytes()]
            at = m.end()
        return b"".join(out) + self.plain(text[at:])


def encoded_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32), with `ids` on demand, of every piece. `row` tells rows with one id apart."""
    rows = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state("piece-ids", tokenizer_path, lambda: PieceEncoder(tokenizer_path))
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), [[] for _ in schema]
                for row, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    ids = encoder.encode(text or "") + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a : 4 * b]
                        for column, value in zip(out, (row, doc_id, k, a, b - a, zlib.crc32(own), np.frombuffer(own, "<i4"))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        give_back_memory()

    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: for each k, items over capacity - k are alone, items over half take a bin each, and
    the items from k to half have to go beside those or into bins of their own."""
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    count, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(capacity + 1))]
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = count[-1] - count[capacity - k + 1]
    large, large_sum = count[capacity - k + 1] - count[half + 1], total[capacity - k + 1] - total[half + 1]
    small_sum = total[half + 1] - total[k]
    return int((alone + large + np.maximum(0, -((large * capacity - large_sum - small_sum) // capacity))).max())


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room for it."""
    owner, fills = np.empty(len(sizes), np.int64), []
    rooms: list[int] = []  # the different amounts of room, in order
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                del rooms[at]
        owner[i] = b
        fills[b] += size
        if room > size:
            if not with_room[room - size]:
                insort(rooms, room - size)
            with_room[room - size].append(b)
    return owner


def pairs_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of items with one owner; owners are sorted."""
    first, second, lag = [], [], 1
    while len(at := np.flatnonzero(owner[lag:] == owner[:-lag])):
        first.append(at)
        second.append(at + lag)
        lag += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64), np.empty(0, np.int64))


def best_exchange(a: int, sizes: np.ndarray, owner: np.ndarray, fill: np.ndarray, items: np.ndarray, capacity: int) -> tuple[list[int], list[int]] | None:
    """What leaves bin a, and what of one other bin comes back for it, so that the sum of squared fills grows most; None if
    nothing makes it grow. Moves come first, then one for one, two for one, one for two. items: those of underfull bins."""
    own = items[owner[items] == a]
    items = items[owner[items] != a]
    items = items[np.argsort(owner[items], kind="stable")]
    bins = owner[items]
    room, ahead = capacity - fill[bins], fill[bins] - fill[a]
    one, two = np.triu_indices(len(own), 1)
    two_sizes, at = np.unique(sizes[own[one]] + sizes[own[two]], return_index=True)
    doubles = [(int(x), [int(own[one[i]]), int(own[two[i]])]) for x, i in zip(two_sizes, at)]
    one_sizes, at = np.unique(sizes[own], return_index=True)
    singles = [(int(x), [int(own[i])]) for x, i in zip(one_sizes, at)]

    def best(leaving, back_sizes, room, ahead):
        most, found = 0, None
        for x, out in leaving:
            step = x - back_sizes
            gain = np.where((step > 0) & (step <= room), step * (ahead + step), 0)
            if len(gain) and gain[i := int(gain.argmax())] > most:
                most, found = gain[i], (out, i)
        return found

    if found := best(singles, np.zeros(len(items), np.int64), room, ahead):  # into the bin of an item: a move
        return found[0], [-1 - int(bins[found[1]])]
    for leaving in (singles, doubles):
        if found := best(leaving, sizes[items], room, ahead):
            return found[0], [int(items[found[1]])]
    left, right = pairs_of(bins)
    if found := best(singles, sizes[items[left]] + sizes[items[right]], room[left], ahead[left]):
        return found[0], [int(items[left[found[1]]]), int(items[right[found[1]]])]
    return None


def empty_bins(sizes: np.ndarray, owner: np.ndarray, capacity: int) -> np.ndarray:
    """Improves a packing by exchanges until it has least_bins, or no exchange from the bins that would have to go helps.

    Each exchange increases the sum of squared fills, a whole number, so it ends; a round that empties no bin is the last.
    """
    owner = owner.copy()
    fill = np.bincount(owner, sizes).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    excess = int((fill > 0).sum()) - least_bins(sizes, capacity) if len(sizes) else 0
    while excess > 0:
        emptied, items = 0, np.flatnonzero(fill[owner] < capacity)
        order = np.argsort(fill, kind="stable")
        for a in order[(fill[order] > 0) & (fill[order] < capacity)][: 2 * excess + 8].tolist():
            while fill[a] and (found := best_exchange(a, sizes, owner, fill, items, capacity)):
                out, back = found
                b = -1 - back[0] if back[0] < 0 else owner[back[0]]
                back = [i for i in back if i >= 0]
                step = sizes[out].sum() - sizes[back].sum()
                owner[out], fill[a], fill[b] = b, fill[a] - step, fill[b] + step
                owner[back] = a
            if not fill[a]:
                emptied, excess = emptied + 1, excess - 1
                if not excess:
                    break
        if not emptied:
            break
    return owner


def packed(table: pa.Table, capacity: int, level: int, part: int, last: bool) -> pa.Table:
    """The pieces of one task with sequence_id, offset, and whether their sequence is to be dealt out again."""
    table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
    sizes = table["length"].to_numpy().astype(np.int64)
    owner = empty_bins(sizes, best_fit(sizes, capacity), capacity)
    order = np.argsort(owner, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    offset = np.empty(len(sizes), np.int64)
    heads = np.r_[True, owner[order][1:] != owner[order][:-1]] if len(sizes) else np.empty(0, bool)
    offset[order] = before - np.repeat(before[heads], np.diff(np.r_[np.flatnonzero(heads), len(sizes)]))
    fill, pieces = np.bincount(owner, sizes), np.bincount(owner)
    emptiest = np.argsort(fill, kind="stable")
    emptiest = emptiest[(pieces[emptiest] > 0) & (fill[emptiest] < capacity)]
    again = np.zeros(len(fill), bool)
    if not last:
        again[emptiest[np.cumsum(pieces[emptiest]) <= max(REOPENED * len(sizes), pieces[emptiest[:1]].sum())]] = True
    sequence = owner + (level << 56 | part << 32)
    for name, values in (("sequence_id", pa.array(sequence)), ("offset", pa.array(offset)), ("again", pa.array(again[owner]))):
        table = table.append_column(name, values)
    return table


def pack_pieces(pieces: DataFrame, capacity: int, space: Workspace, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces: (row, piece, length, ...), a table that reads the same each time; adds sequence_id and offset, gapless from 0.

    A piece as long as a sequence has one of its own. The rest are dealt out by a hash, `task_pieces` to a task on average, so a
    task holds that many lengths and no text; each level has about a quarter of the pieces of the one before, and the
    last is one task. Sequence ids are unique numbers without further meaning.
    """
    pieces = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    rest, done, level, before = pieces.filter(F.col("length") < capacity).drop("sequence_id", "offset"), [full], 0, math.inf
    schema = rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "again": F.lit(False)}).schema
    while n := rest.count():
        tasks = -(-n // task_pieces)
        last, before = tasks == 1 or n > 0.75 * before, n  # tasks of a few pieces each could go on for ever
        dealt = rest.repartition(tasks, F.xxhash64(F.lit(level), "row", "piece")) if tasks > 1 else rest.coalesce(1)

        def run(batches: Iterator[pa.RecordBatch], level=level, last=last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            if held := list(batches):
                yield from packed(pa.Table.from_batches(held), capacity, level, TaskContext.get().partitionId(), last).to_batches()

        made = space.written(dealt.mapInArrow(run, schema), f"level-{level}")
        done.append(made.filter("not again").drop("again"))
        rest, level = made.filter("again").select(*rest.columns), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, task_pieces: int = TASK_PIECES, **columns: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row, with `ids` on demand.

    A document is its ids by the tokenizers library and end_id. One longer than `capacity` is cut into pieces of that length,
    the first of which may be shorter; others are one piece. No sequence has more than `capacity` ids. ids_crc32 is over a
    piece's ids as little-endian unsigned 32-bit integers.

    A null or empty text is end_id alone. Repeated rows are documents of their own; a null id stays null; an empty table gives
    no row; other columns are not read. The tokenizer file has to be at the same path on every executor.
    """
    with Workspace(docs.sparkSession, "packed") as space:
        pieces = space.written(encoded_pieces(docs, tokenizer_path, end_id, capacity, with_ids, **columns), "pieces")
        narrow = pieces.drop("ids")
        placed = pack_pieces(narrow, capacity, space, task_pieces)
        if with_ids:
            placed = placed.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
        return space.finish(placed.drop("row"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of each sequence of pack_documents with ids: training rows, at most `capacity` ids each."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(own.alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
