"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

Tasks find terms as runs of letter bytes by a lookup table over the UTF-8 buffer of a batch, group equal runs by xxhash,
verify each group byte by byte, and send one count per term, source and block of text. Terms then meet by (language, term),
and tasks over the kept terms read the list column of (source, count) as a sparse matrix, from which they sum divergences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import give_back_memory
from trendloom.session import Workspace

#: 1 for the bytes of a term: ASCII letters and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
#: A-Z become a-z, all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

#: Bytes of text whose terms are counted at once.
BLOCK_BYTES = 12_000_000
#: Slices hashed or verified at once, which bounds the memory for it whatever the length of a text.
SLICES = 200_000
#: Probabilities are in units of one part in this many.
UNIT = 1_000_000_000


def term_slices(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in texts that lie one after another, text i from offsets[i] to offsets[i + 1]."""
    inside = LETTER[buffer]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]  # a term never crosses from one text into the next
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def differs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether any slice differs from the slice whose number `other` has for it."""
    for at in range(0, len(starts), SLICES):
        a, n, b = starts[at : at + SLICES], (ends - starts)[at : at + SLICES], starts[other[at : at + SLICES]]
        if (n != (ends - starts)[other[at : at + SLICES]]).any():
            return True
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (buffer[np.repeat(a, n) + step] != buffer[np.repeat(b, n) + step]).any():
            return True
    return False


def group_slices(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's group of equal slices, and one slice of each group.

    Groups have equal digests; every slice is then compared with its group's. Where two different slices share a digest,
    the block is grouped by the bytes themselves.
    """
    data, hashes = buffer.tobytes(), np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), SLICES):
        pairs = zip(starts[at : at + SLICES].tolist(), ends[at : at + SLICES].tolist())
        hashes[at : at + SLICES] = np.fromiter((digest(data[a:b]) for a, b in pairs), np.uint64, len(starts[at : at + SLICES]))
    _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
    if differs(buffer, starts, ends, one[group]):
        numbers: dict[bytes, int] = {}
        group = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())])
        one = np.unique(group, return_index=True)[1]
    return group, one


def sums_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys in order and the sum of each value over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[heads], [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def block_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array, digest=xxhash.xxh3_64_intdigest) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a block of documents; a row with an empty term for each (lang, source)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    buffer, offsets = FOLD[raw], offsets - offsets[0]
    pairs: dict[tuple, int] = {}
    owner = np.array([pairs.setdefault(p, len(pairs)) for p in zip(langs.to_pylist(), sources.to_pylist())], np.int64)
    starts, ends = term_slices(buffer, offsets)
    group, one = group_slices(buffer, starts, ends, digest)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    width = max(len(one), 1)
    in_doc, (n,) = sums_by(doc * width + group, np.ones(len(group), np.int64))
    keys, (n, docs) = sums_by(owner[in_doc // width] * width + in_doc % width, n, np.ones(len(in_doc), np.int64))
    data = buffer.tobytes()
    terms = pa.array([data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())], pa.binary())
    marks, who = len(pairs), pa.array(np.r_[np.arange(len(pairs)), keys // width])
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in pairs], pa.string()).take(who), pa.array([p[1] for p in pairs], pa.string()).take(who),
        pa.concat_arrays([pa.array([b""] * marks, pa.binary()), terms.take(pa.array(keys % width))]),
        pa.array(np.r_[np.zeros(marks, np.int64), n]), pa.array(np.r_[np.zeros(marks, np.int64), docs])], schema=COUNTS)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block_counts of (lang, source, text), in blocks of about BLOCK_BYTES or one text, if that is longer."""

    def counted(held):
        table = pa.Table.from_batches(held).combine_chunks()
        return block_counts(*(pa.concat_arrays(table[c].chunks) for c in ("lang", "source", "text")))

    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(lengths[start - 1]) if start else 0
            end = max(int(np.searchsorted(lengths, before + BLOCK_BYTES - size, side="right")), start + (not held))
            if end > start:
                held.append(batch.slice(start, end - start))
                size += int(lengths[end - 1]) - before
            if end < batch.num_rows:
                yield counted(held)
                held, size = [], 0
            start = end
    if held:
        yield counted(held)
    give_back_memory()


def scaled(counts: np.ndarray, total: int, pseudo: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + pseudo) / (total + pseudo * terms)) without overflow, by long division in base 1000."""
    rest, over, out = counts.astype(np.int64) + pseudo, total + pseudo * terms, np.zeros(len(counts), np.int64)
    for _ in range(4):
        out = out * 1000 + rest // over
        rest = rest % over * 1000
    return out + 1


class Language:
    """The sources of a language in order, the counts of all kept terms in each, and the number of kept terms."""

    def __init__(self, sources: list[str], totals: list[int], terms: int, pseudo: int):
        self.sources, self.terms, self.pseudo = sources, terms, pseudo
        self.totals, self.number = totals, {s: i for i, s in enumerate(sources)}
        self.absent = np.array([scaled(np.zeros(1, np.int64), t, pseudo, terms)[0] if terms else 0 for t in totals], np.int64)


def block_divergences(lang: Language, terms: list[bytes], starts: np.ndarray, source: np.ndarray, counts: np.ndarray, top: int) -> tuple[list, list]:
    """Of a block of terms: (source, other, sum of differences) for source < other, and (source, term, difference from the
    language), at most the first `top` of a source.

    The block is a sparse matrix with a row for each term: its entries are starts[i] to starts[i + 1]. Its transpose, with a
    row for each source, gives sums over entries by reduceat; terms that neither source has, or only the first, are added
    by the values that absent terms have.
    """
    size = len(lang.sources)
    row = np.repeat(np.arange(len(terms)), np.diff(starts))
    whole = np.add.reduceat(counts, starts[:-1]) if len(counts) else np.zeros(0, np.int64)
    of_lang = scaled(whole, sum(lang.totals), lang.pseudo, lang.terms)
    order = np.argsort(source, kind="stable")
    row, source, counts = row[order], source[order], counts[order]
    ends = np.searchsorted(source, np.arange(size + 1))
    p = np.concatenate([np.empty(0, np.int64), *(scaled(counts[a:b], lang.totals[s], lang.pseudo, lang.terms) for s, (a, b) in enumerate(zip(ends, ends[1:])) if b > a)])
    pairs, best = [], []
    held = np.flatnonzero(ends[1:] > ends[:-1])
    for s in range(size):
        a, b = ends[s], ends[s + 1]
        own = np.full(len(terms), lang.absent[s])
        own[row[a:b]] = p[a:b]
        # all terms against the value of an absent term in each other source
        values = np.sort(p[a:b])
        below, total = np.searchsorted(values, lang.absent), np.r_[0, np.cumsum(values)]
        sums = (len(terms) - (b - a)) * np.abs(lang.absent[s] - lang.absent)
        sums += total[-1] - 2 * total[below] + (2 * below - (b - a)) * lang.absent
        # entries of the other sources take their own value instead
        if len(held):
            change = np.abs(own[row] - p) - np.abs(own[row] - lang.absent[source])
            sums[held] += np.add.reduceat(change, ends[held])
        pairs.extend((s, t, int(sums[t])) for t in range(s + 1, size))
        more = p[a:b] - of_lang[row[a:b]]
        at = np.flatnonzero(more > 0)
        if len(at) > top:  # all that are no less than the last of the first `top`, ties included
            at = at[more[at] >= np.partition(more[at], len(at) - top)[len(at) - top]]
        found = sorted((-int(more[i]), terms[row[a + i]]) for i in at.tolist())
        best.extend((s, term, -value) for value, term in found[:top])
    return pairs, best


PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def sum_divergences(languages: dict[str, Language], top: int):
    """A function over (lang, term, sources array<string>, counts array<long>) sorted by lang; the row of a language's empty
    term gives each pair of its sources with 0, so that pairs come out for languages without a kept term too."""

    def made(name: str, pairs: list, best: list) -> pa.RecordBatch:
        s = languages[name].sources
        rows = [(s[a], "pair", s[b], v) for a, b, v in pairs] + [(s[a], "term", t.decode(), v) for a, t, v in best]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(PARTS)[1:]))], schema=PARTS)

    def block(name: str, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lang = languages[name]
        terms = [t for b in held for t in b.column("term").to_pylist()]
        names = pa.concat_arrays([b.column("sources").flatten() for b in held]).dictionary_encode()
        number = np.array([lang.number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        counts = pa.concat_arrays([b.column("counts").flatten() for b in held]).to_numpy(zero_copy_only=False)
        sizes = np.concatenate([pc.list_value_length(b.column("counts")).to_numpy(zero_copy_only=False) for b in held])
        return made(name, *block_divergences(lang, terms, np.r_[0, np.cumsum(sizes)].astype(np.int64), number, counts, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, entries = [], None, 0
        for batch in batches:
            names = batch.column("lang").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (names[a] != name or entries >= min(max(len(languages[name].sources) ** 2, 250_000), 4_000_000)):
                    yield block(name, held)
                    held, entries = [], 0
                name, part = names[a], batch.slice(a, b - a)
                if pc.any(is_mark := pc.equal(pc.binary_length(part.column("term")), 0)).as_py():
                    size = len(languages[name].sources)
                    for s in range(size):
                        yield made(name, [(s, t, 0) for t in range(s + 1, size)], [])
                    part = part.filter(pc.invert(is_mark))
                if part.num_rows:
                    held.append(part)
                    entries += pc.sum(pc.list_value_length(part.column("counts"))).as_py()
        if held:
            yield block(name, held)
        give_back_memory()

    return run


def source_divergence(docs: DataFrame, least_docs: int = 30, pseudo: int = 5, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs.

    A term is a run of letters (A-Z lower-cased, everything beyond ASCII a letter); a language keeps the terms in `least_docs`
    or more of its documents. With p = 1 + floor(UNIT * (count + pseudo) / (total + pseudo * terms)) for each kept term in a source
    and in the language: part `pair` has for each other source of the language the sum of |p - q| over all kept terms, part
    `term` the `top` terms of a source with the largest p - q over the language's q, above 0. Ranks go by value, largest
    first, then by item in UTF-8 order.

    Null text, lang and source count as empty strings. Repeated rows are documents of their own, also with one id; other
    columns are not read. A source without terms has its pairs, a language with one source has none, an empty table gives no
    row. A text of any length is counted whole. The names, totals and values of sources are the only table sent to
    tasks and the driver; the result has a row for each pair of them, so the table is as its square root.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    with Workspace(spark, "divergence") as space:
        # dealt by (lang, term) once, which serves both groupings; blocks are summed in tasks before
        counts = rows.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
        by_term = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
        kept = space.written(by_term.filter((F.length("term") == 0) | (F.col("docs") >= least_docs)), "kept")
        sizes = {r.lang: r.terms for r in kept.groupBy("lang").agg(F.count_if(F.length("term") > 0).alias("terms")).collect()}
        found: dict[str, list] = {}
        for r in kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("n")).collect():
            found.setdefault(r.lang, []).append((r.source, r.n))
        languages = {k: Language([s for s, _ in sorted(v)], [n for _, n in sorted(v)], sizes[k], pseudo) for k, v in found.items()}
        lists = kept.select("lang", "term", F.col("entries.source").alias("sources"), F.col("entries.n").alias("counts")).sortWithinPartitions("lang")
        parts = lists.mapInArrow(sum_divergences(languages, top), "lang string, source string, part string, item string, value long")
        parts = space.written(parts, "parts")
        pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
        rows = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").unionByName(parts.filter("part = 'term'"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return space.finish(rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top)))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), in_doc AS (SELECT row, lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM in_doc GROUP BY ALL HAVING count(*) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang
), counts AS (SELECT lang, source, term, sum(i.n)::BIGINT AS n FROM in_doc i SEMI JOIN kept k USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
