"""N-gram Jaccard join with a count-vector R-tree.

Each document is its set of distinct word shingles. The elements are hashed into groups, and the counts of the groups
are a point; the sum over the groups of the smaller counts bounds the overlap of two sets from above. The points stand
in R-trees whose nodes hold the greatest count of each group, so a query skips a node whose bound is under the overlap
that the threshold needs. Surviving pairs are verified on the exact sets.

Trees are built per cell. A set of n elements must share ceil(t n) of them with a partner, so it shares one of its
first n - ceil(t n) + 1 in any order that all sets use: the sets with such a prefix element in common are a cell, and no
link is missed. The order puts the hash of an element first and elements that are very frequent (by a bounded sample;
it changes the speed only) last, so that common passages make few cells. Equal sets are one class from the start. Before
the trees, stars link each set of a cell with one set of the cell, and then those still apart with a few others, which
joins groups of near copies in a number of pairs that grows with their size, not its square; the trees then look for
pairs in different components only. A cell with very many sets is cut into blocks, most of them of one component; each block
that is not of the largest component is searched against each other block, as a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import WORDS, hash_sample, id_text, map_texts
from trendloom.llm.shingles import worker_hasher
from trendloom.operators.components import connected_components
from trendloom.session import Workspace

#: Groups of a count vector: enough to tell sets of some 20,000 elements apart at the usual thresholds.
GROUPS = 512
#: Counts are kept in a byte; this one stands for any number from it on.
FULL = 255
#: Ids that are broadcast at most, 8 bytes each; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000
#: A cell is cut into blocks of about BLOCK sets if it has HOT or more sets in one of SAMPLED parts, by a hash, of all sets. Which
#: cells are cut changes the speed only.
BLOCK, SAMPLED, HOT = 512, 64, 12


class ShingleSets:
    """Sets of shingle hashes of texts: words are runs of anything but ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width, self.hasher = width, worker_hasher()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted and distinct. Fewer words than the width are one shingle; no words, none."""
        words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        if not words:
            return np.empty(0, np.uint64)
        return np.unique(self.hasher.runs(self.hasher.words(words), min(self.width, len(words))))


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which sets of n and m elements link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def frequent_shingles(docs: DataFrame, width: int, sample_docs: int = 4_000, least: int = 4, size: int = 65_536) -> np.ndarray:
    """Hashes in `least` or more of about sample_docs documents, the `size` most frequent; they only go last in the order."""

    def make():
        sets = ShingleSets(width)

        def apply(ids, texts):
            found = [sets.of(t) for t in texts]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), [])
            return {"h": h.view(np.int64), "n": n}

        return apply

    counts = map_texts(hash_sample(docs, sample_docs, salt=10), "h long, n long", make).groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(size).toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def describe_sets(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, sig1, sig2, counts, keys): the size, a 128-bit signature of the set, group counts and prefix elements."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        sets, last = ShingleSets(width), shared.value
        table = np.zeros(1 << 20, bool)
        table[last >> np.uint64(44)] = True

        def one(text):
            h = sets.of(text)
            n = len(h)
            if not n:
                return 0, 0, 0, b"", []
            mixed = h * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            counts = np.bincount((mixed >> np.uint64(7)).astype(np.int64) & GROUPS - 1, minlength=GROUPS)
            late = table[h >> np.uint64(44)]
            if late.any():
                late[late] = np.isin(h[late], last, assume_unique=True)
                h = np.concatenate([h[~late], h[late]])
            signature = np.array([mixed.sum(dtype=np.uint64), (mixed * (mixed >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64)]).view(np.int64)
            return n, int(signature[0]), int(signature[1]), np.minimum(counts, FULL).astype(np.uint8).tobytes(), h[: n - -(-percent * n // 100) + 1].view(np.int64)

        def apply(ids, texts):
            return {"doc_id": ids} | dict(zip(("n", "sig1", "sig2", "counts", "keys"), zip(*[one(t) for t in texts])))

        return apply

    return map_texts(docs, "doc_id long, n long, sig1 long, sig2 long, counts binary, keys array<long>", make)


def count_matrix(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Counts as rows; a count that did not fit stands for any number, so it becomes the size of the set."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)
    kind = np.int16 if len(sizes) and sizes.max() < 32_768 else np.int64
    full = flat == FULL
    return np.where(full, sizes[:, None], flat).astype(kind) if full.any() else flat.astype(kind)


class CountVectorTree:
    """An R-tree over points, bulk-loaded by cutting at the median of the size, then of the widest coordinate, in turn.

    rooms: how many elements of a set stand from the cell's key on; two sets whose first common element that is cannot
    share more than the smaller room. sides: if any is 1, only the rows of side 1 stand in the tree, and those of side 0 ask.
    """

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rooms: np.ndarray, marks: np.ndarray, sides: np.ndarray, percent: int):
        self.points, self.sizes, self.rooms, self.marks, self.percent = points, sizes, rooms, marks.copy(), percent
        self.crossing = bool(sides.any())
        self.asking = np.flatnonzero(sides == 0)
        self.nodes: list[tuple] = []
        self.root = self.load(np.flatnonzero(sides == self.crossing), 0)

    def load(self, own: np.ndarray, depth: int) -> int:
        """Each node: greatest counts, least and greatest size, a row whose mark all have (None if mixed), and rows or two nodes."""
        marks = self.marks[own]
        same = own[0] if (marks == marks[0]).all() else None
        below = own
        if len(own) > self.LEAF:
            by = self.sizes[own] if depth % 2 == 0 else self.points[own, np.argmax(np.ptp(self.points[own], axis=0))]
            order = own[np.argsort(by, kind="stable")]
            half = len(order) // 2
            below = (self.load(order[:half], depth + 1), self.load(order[half:], depth + 1))
        self.nodes.append((self.points[own].max(axis=0), self.sizes[own].min(), self.sizes[own].max(), same, below))
        return len(self.nodes) - 1

    def pairs(self, slack: bool = False, step: int = 2048) -> Iterator[tuple[np.ndarray, int]]:
        """Rows i and a row j, of different marks, whose overlap bound reaches the overlap needed, with `slack` and what may come
        by chance over it; j > i unless the sides cross. Marks may be joined between two results."""
        for start in range(0, len(self.asking), step):
            stack = [(self.root, self.asking[start : start + step])]
            while stack:
                node, queries = stack.pop()
                greatest, least_n, most_n, same, below = self.nodes[node]
                n = self.sizes[queries]
                ok = (100 * least_n <= 10_000 * n // self.percent) & (100 * most_n >= self.percent * n)
                if same is not None:
                    ok &= self.marks[queries] != self.marks[same]
                queries = queries[ok]
                if not len(queries):
                    continue
                bound = np.minimum(self.points[queries], greatest).sum(axis=1)
                n = self.sizes[queries]
                queries = queries[bound >= needed(n, np.maximum(least_n, -(-self.percent * n // 100)), self.percent)]
                if not len(queries):
                    continue
                if isinstance(below, tuple):
                    stack += [(below[0], queries), (below[1], queries)]
                    continue
                for j in below:
                    i = queries[(self.crossing | (queries < j)) & (self.marks[queries] != self.marks[j])]
                    i = i[np.minimum(self.rooms[i], self.rooms[j]) >= needed(self.sizes[i], self.sizes[j], self.percent)]
                    if len(i):
                        bound = np.minimum(self.points[i], self.points[j]).sum(axis=1)
                        least = needed(self.sizes[i], self.sizes[j], self.percent)
                        if slack:
                            least = np.minimum(least + by_chance(self.sizes[i], self.sizes[j], bound), np.minimum(self.sizes[i], self.sizes[j]))
                        i = i[bound >= least]
                        if len(i):
                            yield i, j

    def forest(self) -> list[tuple[int, int]]:
        """Pairs that very likely link and that join the marks as far as such pairs do: fewer than there are rows."""
        found = []
        for i, j in self.pairs(slack=True):
            other, first = np.unique(self.marks[i], return_index=True)
            for mark, at in zip(other, first):
                if mark != self.marks[j]:
                    found.append((int(i[at]), int(j)))
                    self.marks[self.marks == mark] = self.marks[j]
        return found


def by_chance(n: np.ndarray, m: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """About how much of an overlap bound comes from different elements that share a group."""
    return 1 + 2 * (n - np.minimum(n, bound)) * (m - np.minimum(m, bound)) // GROUPS


def search_cells(cells: DataFrame, percent: int, forests: bool, small: int = 8) -> DataFrame:
    """(key, a, b, stands_for), a < b, of pairs in a group whose components differ and whose bound holds; a pair may come from
    several groups.

    cells: (key, group, side, rep, component, n, room, counts); a group is a cell, all of side 0, or two blocks of one. Groups
    of up to `small` rows are compared row with row, larger ones by a tree. With `forests` a larger group gives first a forest
    of pairs that very likely link (stands_for true), and then only the pairs that this forest leaves apart: if each pair of
    its forest links, nothing is missed.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("stands_for", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(table: pa.Table) -> pa.RecordBatch:
            group, key, side, rep, mark, sizes, rooms = (table.column(i).to_numpy() for i in range(7))
            points = count_matrix(table.column(7), sizes)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(group)]]))
            crossing = np.add.reduceat(side, starts) > 0
            little = np.repeat((lengths <= small) & ~crossing, lengths)
            found = []  # rows i, rows j, whether they are of a forest
            for d in range(1, min(small, len(group))):
                i = np.flatnonzero((group[d:] == group[:-d]) & little[d:] & (mark[d:] != mark[:-d]))
                i = i[np.minimum(rooms[i], rooms[i + d]) >= needed(sizes[i], sizes[i + d], percent)]
                if len(i):
                    bound = np.minimum(points[i], points[i + d]).sum(axis=1)
                    i = i[bound >= needed(sizes[i], sizes[i + d], percent)]
                    found.append((i, i + d, np.zeros(len(i), bool)))
            for s, n in zip(starts[(lengths > small) | crossing], lengths[(lengths > small) | crossing]):
                rows = slice(s, s + n)
                if (mark[rows] == mark[s]).all() or (side[rows] == 1).all():
                    continue
                tree = CountVectorTree(points[rows], sizes[rows], rooms[rows], mark[rows], side[rows], percent)
                if forests and (kept := tree.forest()):
                    i, j = np.array(kept).T
                    found.append((s + i, s + j, np.ones(len(i), bool)))
                found += [(s + i, np.full(len(i), s + j), np.zeros(len(i), bool)) for i, j in tree.pairs()]
            i, j, sure = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
            x, y = rep[i], rep[j]
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sure.astype(bool))], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if cut:
                yield search(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield search(pa.Table.from_batches(held))

    dealt = cells.repartition("group").sortWithinPartitions("group", "rep").select("group", "key", "side", "rep", "component", "n", "room", "counts")
    return dealt.mapInArrow(run, "key long, a long, b long, stands_for boolean")


def block_pairs(cells: DataFrame) -> DataFrame:
    """Large cells as groups for search_cells, of two blocks or one block each; cells of a single component give none.

    cells: (key, rep, component, n, room, counts). A component of BLOCK / 2 rows or more is dealt to blocks of its own by a hash
    of the row, smaller ones share blocks by a hash of the component. Blocks of a cell's largest component are not paired with
    each other, nor searched alone: the number of pairs is that of blocks times that of the rest's blocks.
    """
    size = cells.groupBy("key", "component").agg(F.count("*").alias("rows"))
    large = F.col("rows") >= BLOCK // 2
    of_key = size.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("rows", "component"))["component"].alias("largest"),
                                     F.sum(F.when(large, 0).otherwise(F.col("rows"))).alias("in_small")).filter("components > 1")
    dealt = cells.join(size, ["key", "component"]).join(of_key, "key")
    part = lambda value, rows: F.pmod(F.xxhash64(value), F.ceil(rows / BLOCK))
    block = F.when(large, F.xxhash64("component", part("rep", F.col("rows")))).otherwise(F.xxhash64(F.lit("shared"), part("component", F.col("in_small"))))
    dealt = dealt.select("key", "rep", "component", "n", "room", "counts", block.alias("block"), (large & (F.col("component") == F.col("largest"))).alias("main"))
    blocks = dealt.select("key", "block", "main").distinct()
    asks = blocks.filter("not main").select("key", F.col("block").alias("asks"))
    pairs = asks.join(blocks, "key").filter("main or asks <= block").withColumn("group", F.xxhash64("key", "asks", "block"))
    sides = [pairs.select("key", "group", F.col("asks").alias("block"), F.lit(0).alias("side")), pairs.filter("asks != block").select("key", "group", "block", F.lit(1).alias("side"))]
    return dealt.drop("main").join(sides[0].unionByName(sides[1]), ["key", "block"]).drop("block")


def bounded_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap bound holds."""
    left = points.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    right = points.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    rows = pairs.join(left, "b").join(right, "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                bound = np.minimum(count_matrix(batch.column(4), na), count_matrix(batch.column(5), nb)).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(bound >= needed(na, nb, percent)))

    return rows.mapInArrow(run, "a long, b long").distinct()


def linked_pairs(space: Workspace, pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose exact sets link."""
    ids = space.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    texts = space.written(texts, "texts")
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, last = ShingleSets(width), (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last[0]:
                    last = (ta, sets.of(ta))
                a, b = last[1], sets.of(tb)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, stars_later: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest id reachable by links, itself included.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A null or empty text, and one
    without words, has the empty set and links with nothing. Rows of one id are one document, so they share a component
    whatever their texts. A row with a null id has n_shingles, and a null component. An empty table gives none. Other
    columns are not read.
    """
    rows = id_text(docs, id_col, text_col)
    with Workspace(docs.sparkSession, "jaccard") as space:
        return space.finish(components_of(space, rows, width, percent, stars_later))


def cells_of(classes: DataFrame, percent: int, stars: int) -> DataFrame:
    """(key, rep, n, room, large, star0, star1, ...): the sets of each cell that may have a partner there, and of the cell one
    set for each star. `large` cells are those that a sample of the sets shows to be; they are never sorted as a whole."""
    by_key = Window.partitionBy("key")
    by_size = by_key.orderBy("n")
    own = lambda sets: sets.select(F.posexplode("keys").alias("at", "key"), "rep", F.col("n").cast("int").alias("n")).withColumn("room", F.col("n") - F.col("at")).drop("at")
    sample = own(classes.filter(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(SAMPLED)) == 0))
    hot = [r.key for r in sample.groupBy("key").count().filter(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(BROADCAST_IDS).select("key").collect()]
    hot = F.broadcast(classes.sparkSession.createDataFrame([(k,) for k in hot], "key long"))  # BROADCAST_IDS at most
    postings = own(classes)
    # the largest set that can link with this one if the key is the first element they share; a set that no smaller one
    # of the cell reaches, and that reaches no larger one, has no partner there
    reach = F.floor(F.least(100 * F.col("n") / percent, (100 + percent) * F.col("room") / percent - F.col("n")))
    reached = [F.lead("n").over(by_size) <= reach, F.max(reach).over(by_size.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("n")]
    star = lambda r: F.min(F.struct(F.xxhash64("rep", F.lit(r)).alias("o"), "rep"))
    names = [f"star{r}" for r in range(stars)]
    cold = postings.join(hot, "key", "left_anti").select("key", "rep", "n", "room", *[F.coalesce(x, F.lit(False)).alias(f"near{i}") for i, x in enumerate(reached)]).filter("near0 or near1")
    cold = cold.select("key", "rep", "n", "room", F.lit(False).alias("large"), *[star(r).over(by_key)["rep"].alias(x) for r, x in enumerate(names)])
    large = postings.join(hot, "key", "left_semi")
    chosen = large.groupBy("key").agg(*[star(r)["rep"].alias(x) for r, x in enumerate(names)])
    return cold.unionByName(large.join(chosen, "key").select("key", "rep", "n", "room", F.lit(True).alias("large"), *names))


def classes_of(space: Workspace, rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n, counts, keys, ...) of each distinct set, rep its smallest id, and (doc_id, n, rep) of every row; rows without a set,
    or of a null id, stand for themselves."""
    sets = space.written(describe_sets(rows, width, percent, frequent_shingles(rows, width)), "sets")
    real = sets.filter("n > 0 and doc_id is not null")
    classes = space.written(real.groupBy("sig1", "sig2").agg(F.min(F.struct("doc_id", "n", "counts", "keys")).alias("x")).select(
        "sig1", "sig2", F.col("x.doc_id").alias("rep"), "x.n", "x.counts", "x.keys"), "classes")
    member = space.written(sets.join(classes.select("sig1", "sig2", "rep"), ["sig1", "sig2"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "members")
    space.drop(sets)
    return classes, member


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b), a < b, of class representatives, and members (doc_id, n_shingles, rep) for every row.

    Rows with equal sets are one class, rep their smallest id, and link with each other without a pair; every two classes that
    link are a pair, once. Empty sets have a null rep, as have rows with a null id, and link with nothing. An id with several
    texts stands for all of them: it links where one of them does, and classes whose smallest id it is count as one. An empty
    table gives two empty ones. Other columns are not read.

    The number of pairs grows with the square of a group of near copies, as each of them is asked for; copies that are equal
    don't count. Where only groups are needed, jaccard_components takes far fewer.
    """
    rows = id_text(docs, id_col, text_col)
    with Workspace(docs.sparkSession, "jaccard-join") as space:
        classes, member = classes_of(space, rows, width, percent)
        cells = cells_of(classes, percent, 1).drop("star0").join(classes.select("rep", "counts"), "rep").withColumn("component", F.col("rep"))
        cells = space.written(cells, "cells")
        groups = cells.filter("not large").drop("large").withColumns({"group": F.col("key"), "side": F.lit(0)})
        found = search_cells(groups.unionByName(block_pairs(cells.filter("large").drop("large"))), percent, forests=False)
        pairs = space.written(found.select("a", "b").distinct(), "pairs")
        real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        members = space.finish(member.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.col("rep")).alias("rep")))
        return space.finish(linked_pairs(space, pairs, rows, width, percent).distinct()), members


def components_of(space: Workspace, rows: DataFrame, width: int, percent: int, stars_later: int) -> DataFrame:
    classes, member = classes_of(space, rows, width, percent)
    points = classes.select("rep", "n", "counts")
    cells = space.written(cells_of(classes, percent, stars_later + 1), "cells")

    same_id = member.join(member.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a != rep").select("a", F.col("rep").alias("b"))
    links, tried, component = space.written(same_id, "same-id"), None, None
    for names in (["star0"], [f"star{r}" for r in range(1, stars_later + 1)]):
        proposed = cells.select("rep", F.explode(F.array(*names)).alias("star")).filter("star != rep").distinct()
        if component is not None:
            far = component.select(F.col("node").alias("star"), F.col("component").alias("far"))
            proposed = with_components(proposed, component).join(far, "star", "left").filter(F.col("component") != F.coalesce("far", "star"))
        pairs = proposed.select(F.least("star", "rep").alias("a"), F.greatest("star", "rep").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = space.written(bounded_pairs(pairs, points, percent), "star-pairs")
        links = space.written(links.unionByName(linked_pairs(space, pairs, rows, width, percent)), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        component = connected_components(links)

    for forests in (True, False):
        marked = with_components(cells.select("key", "rep", "n", "room", "large"), component)
        by_key = Window.partitionBy("key")
        mixed = marked.filter("not large").withColumn("mixed", F.min("component").over(by_key) != F.max("component").over(by_key)).filter("mixed").drop("large", "mixed")
        whole = mixed.join(points.select("rep", "counts"), "rep").withColumns({"group": F.col("key"), "side": F.lit(0)})
        large = space.written(marked.filter("large").drop("large").join(points.select("rep", "counts"), "rep"), "large")
        found = space.written(search_cells(whole.unionByName(block_pairs(large)), percent, forests), "tree-pairs")
        space.drop(large)
        pairs = space.written(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "new-pairs")
        more = space.written(linked_pairs(space, pairs, rows, width, percent), "more-links")
        links, tried = links.unionByName(more), tried.unionByName(pairs)
        component = connected_components(links)
        # cells with a pair of a forest that does not link are searched again, pair by pair
        failed = space.written(found.filter("stands_for").join(more, ["a", "b"], "left_anti").select("key").distinct(), "again")
        if failed.isEmpty():
            break
        cells = cells.join(failed, "key", "left_semi")
    final = member.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return final.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def with_components(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Adds component; a rep without links is its own."""
    known = component.select(F.col("node").alias("rep"), "component")
    return rows.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
