"""Quality rules by compression bands.

zstandard's ratio (compressed bytes to bytes) over the whole text and over fixed chunks of it, the last of which ends with
the text, so that every byte of a text from one chunk on is judged in a chunk and a shorter text as a whole: repetitive text
compresses far more than prose of its length, random text far less. The limits depend on the length, since short texts
of any kind compress little, and on the script, since letters of several bytes compress more. They are learned from the
ratios of all documents: what lies far outside the middle half of its length and script is rejected.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import WORDS, id_text, keep_rows, map_texts, worker_state
from trendloom.session import Workspace

SYMBOLS = "#*$%&|<>"


#: Least bytes of the length bands, half an octave each.
LENGTHS = (0, 256, 362, 512, 724, 1024, 1448, 2048, 2896, 4096, 5793, 8192, 11585, 16384, 23170, 32768, 65536)
#: The bytes a character from which the next class of scripts starts: Latin; Greek, Cyrillic and the like; the rest.
SCRIPTS = (1.3, 2.3)
#: Stands for the chunks, of whatever text, in place of a length band.
CHUNKS = -1


@dataclass(frozen=True)
class CompressionBands:
    """How limits are learned for each script and length band, and once a script for chunks of chunk_bytes.

    From ratios with quartiles q1 and q3 the limits are q1 - below * (q3 - q1) and q3 + above * (q3 - q1), and at least
    `margin` from the quartile. Equal texts count once. A text with more than max_bad_chunks of its chunks outside is rejected.

    A band with fewer than `enough` ratios is filled up to that weight: by its neighbours on both sides, nearest first, each
    only as far as it is needed and moved by what a typical ratio changes from there to here; and what is still missing then is
    the weight of `wide`, (least bytes, lowest ratio, highest ratio), or wide_chunks, in the limits. So limits change
    gradually with the number of texts, and a full band knows nothing of others. Texts under 256 bytes have no neighbours.
    """

    wide: tuple[tuple[int, float, float], ...] = ((0, 0.20, 1.60), (256, 0.25, 0.90), (1024, 0.22, 0.75), (4096, 0.18, 0.68), (32768, 0.12, 0.65))
    wide_chunks: tuple[float, float] = (0.18, 0.75)
    chunk_bytes: int = 1024
    max_bad_chunks: float = 0.25
    below: float = 2.0
    above: float = 3.0
    margin: float = 0.02
    enough: int = 40
    typical: tuple[tuple[int, float], ...] = ((256, 0.65), (1024, 0.52), (4096, 0.46), (16384, 0.42), (65536, 0.39))
    level: int = 3

    def typical_ratio(self, band: int) -> float:
        """Of texts of a band's least bytes, between the points of `typical` by the logarithm of the length."""
        size, points = max(LENGTHS[band], self.typical[0][0]), self.typical
        at = min(bisect_right(points, (size, 2.0)), len(points) - 1)
        (a, x), (b, y) = points[at - 1], points[at]
        return x + (y - x) * min(1.0, math.log(size / a) / math.log(b / a))


class RatioMeter:
    def __init__(self, bands: CompressionBands):
        self.bands, self.packer = bands, zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, data: bytes) -> float:
        return len(self.packer.compress(data)) / len(data) if data else 1.0

    def measure(self, text: str) -> tuple[int, int, float, list[int]]:
        """The script class, the length band, the whole ratio, and the ratio of each chunk in thousandths; chunks stand one
        after another, but the last is moved back so that it ends with the text."""
        data, size = text.encode("utf-8", "surrogatepass"), self.bands.chunk_bytes
        starts = [*range(0, len(data) - size + 1, size)]
        if starts and len(data) % size:
            starts.append(len(data) - size)
        chunks = [round(1000 * self.ratio(data[s : s + size])) for s in starts]
        return bisect_right(SCRIPTS, len(data) / max(len(text), 1)), bisect_right(LENGTHS, len(data)) - 1, self.ratio(data), chunks


Limits = dict[tuple[int, int], tuple[float, float]]


def learned_limits(measured: DataFrame, bands: CompressionBands) -> Limits:
    """The limits of each script and length band, or CHUNKS, from rows (digest, script, band, ratio, chunks)."""
    once = measured.filter("digest is not null").select("digest", "script", "band", F.round(F.col("ratio") * 1000).cast("int").alias("r"), "chunks").distinct()
    each = once.select("script", F.explode(F.concat(F.array(F.struct("band", "r")), F.transform("chunks", lambda c: F.struct(F.lit(CHUNKS).alias("band"), c.alias("r"))))).alias("x"))
    counts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # a row a thousandth at most
    for script, band, r, n in each.groupBy("script", "x.band", "x.r").count().collect():
        counts.setdefault((script, band), []).append((r, n))
    return {(script, band): band_limits(counts, script, band, bands) for script in range(len(SCRIPTS) + 1) for band in range(CHUNKS, len(LENGTHS))}


def band_limits(counts: dict[tuple[int, int], list[tuple[int, int]]], script: int, band: int, bands: CompressionBands) -> tuple[float, float]:
    """The limits of one band, from the numbers of ratios in thousandths of all bands."""
    found: Counter = Counter()
    missing = float(bands.enough)
    for ring in range(len(LENGTHS) if band > 0 else 1):
        around = [b for b in {band - ring, band + ring} if b == band or 0 < b < len(LENGTHS)]
        n = sum(x for b in around for _, x in counts.get((script, b), []))
        share = min(1.0, missing / n) if ring and n else 1.0
        for b in around:
            move = round(1000 * (bands.typical_ratio(band) - bands.typical_ratio(b))) if ring else 0
            for r, x in counts.get((script, b), []):
                found[r + move] += x * share
        missing -= n * share
        if missing <= 0:
            break
    low, high = bands.wide_chunks if band == CHUNKS else next(x[1:] for x in reversed(bands.wide) if LENGTHS[band] >= x[0])
    missing = max(missing, 0.0) / bands.enough
    if missing == 1:
        return low, high
    total, upto, quartiles = sum(found.values()), 0.0, []
    for r in sorted(found):
        upto += found[r]
        while len(quartiles) < 2 and upto >= total * (0.25, 0.75)[len(quartiles)] - 1e-9:
            quartiles.append(r / 1000)
    q1, q3 = quartiles
    own = q1 - max(bands.below * (q3 - q1), bands.margin), q3 + max(bands.above * (q3 - q1), bands.margin)
    return own[0] + missing * (low - own[0]), own[1] + missing * (high - own[1])


def learn_limits(docs: DataFrame, bands: CompressionBands = CompressionBands(), id_col: str = "doc_id", text_col: str = "text") -> Limits:
    """Limits from all of docs, to judge others by."""

    def make():
        meter = worker_state("quality", bands, lambda: RatioMeter(bands))

        def apply(ids, texts):
            found = [meter.measure(t or "") for t in texts]
            return {"digest": [digest(t) for t in texts]} | dict(zip(("script", "band", "ratio", "chunks"), zip(*found)))

        return apply

    return learned_limits(map_texts(id_text(docs, id_col, text_col), MEASURES, make), bands)


MEASURES = "digest long, script int, band int, ratio double, chunks array<int>"


def digest(text: str | None) -> int | None:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else None


def repeated_words(words: list[str]) -> int:
    """How many words stand in a window of three words that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def repeated_lines(text: str) -> int:
    """How many lines that have a word equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if WORDS.search(x)]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """Words, their characters, symbols, repeated lines, repeated words, and whether the base rule fails."""
    words = WORDS.findall(text)
    repeat = repeated_words(words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def within(limits: Limits, bands: CompressionBands, script: int, band: int, ratio: float, chunks: list[int]) -> bool:
    """The verdict of the bands, as quality_rules has it in columns."""
    (low, high), (chunk_low, chunk_high) = limits[script, band], limits[script, CHUNKS]
    bad = sum(not chunk_low <= c / 1000 <= chunk_high for c in chunks)
    return low <= ratio <= high and bad <= bands.max_bad_chunks * len(chunks)


def keep_good(docs: DataFrame, bands: CompressionBands = CompressionBands(), limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that quality_rules keeps, all columns; each row by its own text. Without limits they are learned from docs."""
    limits = learn_limits(docs, bands, id_col, text_col) if limits is None else limits

    def make():
        meter = worker_state("quality", bands, lambda: RatioMeter(bands))
        return lambda texts: [not base_counts(t or "")[5] and within(limits, bands, *meter.measure(t or "")) for t in texts]

    return keep_rows(docs, make, text_col)


def quality_rules(docs: DataFrame, bands: CompressionBands = CompressionBands(), limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks) for every row.

    Without limits they are learned from docs. A null text counts as empty: no words, all counts 0, base_failed, not kept.
    base_failed: under 50 words, or more than half of the words repeated. bad_chunks: the share of chunks outside the limits, 0 for
    a text under a chunk, which its whole ratio judges. Repeated rows give repeated results, an empty table none; a null id stays null. Other
    columns are not read.
    """

    def make():
        meter = worker_state("quality", bands, lambda: RatioMeter(bands))

        def one(text):
            return (*base_counts(text), digest(text), *meter.measure(text))

        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "digest", "script", "band", "ratio", "chunks")

        def apply(ids, texts):
            return {"doc_id": ids} | dict(zip(names, zip(*[one(t or "") for t in texts])))

        return apply

    schema = f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, {MEASURES}"
    rows = map_texts(id_text(docs, id_col, text_col), schema, make)
    if limits is not None:
        return judged(rows, limits, bands)
    with Workspace(docs.sparkSession, "quality") as space:
        rows = space.written(rows, "measured")  # numbers only; the texts are read once
        return space.finish(judged(rows, learned_limits(rows, bands), bands))


def judged(rows: DataFrame, limits: Limits, bands: CompressionBands) -> DataFrame:
    table = F.broadcast(rows.sparkSession.createDataFrame([(s, b, *map(float, x), *map(float, limits[s, CHUNKS])) for (s, b), x in limits.items()],
                                                          "script int, band int, low double, high double, chunk_low double, chunk_high double"))  # a row a band
    outside = F.size(F.filter("chunks", lambda c: ~(c / 1000).between(F.col("chunk_low"), F.col("chunk_high"))))
    rows = rows.join(table, ["script", "band"]).withColumn("bad_chunks", F.when(F.size("chunks") > 0, outside / F.size("chunks")).otherwise(0.0))
    kept = ~F.col("base_failed") & F.col("ratio").between(F.col("low"), F.col("high")) & (F.col("bad_chunks") <= bands.max_bad_chunks)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio", "bad_chunks")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
