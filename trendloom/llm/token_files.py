"""Token-id files with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents, concatenated. Where document i starts is element i of a monotone sequence
coded by Elias and Fano: the low bits of each element in a packed array, the high bits as a unary bit vector with the
position of every 64th set bit, so that any boundary is found by one sample and a scan of a few words. That takes about
2 + log2(ids / documents) bits for a document, against 64 for a table of offsets.

Layout, little-endian: magic, then eight unsigned 64-bit numbers (bytes an id, documents, ids, low bits, 64-bit words of low
bits, words of high bits, samples, 0), document ids (signed 64 bits), a byte each that is 1 where the document id is null,
low words, high words, samples (unsigned 64 bits), ids.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import UNCOMMON, id_text, worker_state
from trendloom.llm.token_counts import load_tokenizer, special_pattern
from trendloom.session import shared_path, written

MAGIC = b"TLEFIDS1"
SAMPLE = 64


class EliasFano:
    """A monotone sequence of integers from 0 to `last`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        bits = np.zeros((-(-n * low_bits // 64)) * 64, np.uint8)
        for b in range(low_bits):
            bits[np.arange(n) * low_bits + b] = (values >> np.uint64(b)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((-(-(int(ones[-1]) + 1 if n else 0) // 64)) * 64, np.uint8)
        unary[ones] = 1
        pack = lambda x: np.packbits(x, bitorder="little").view("<u8")
        return cls(n, low_bits, pack(bits), pack(unary), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Element i: the i-th set bit is found from the last sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, skip = at // 64, at % 64
        bits = int(self.high[word]) >> skip << skip
        while (count := bits.bit_count()) <= left:
            left, word = left - count, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        start = i * self.low_bits
        low = int.from_bytes(self.low[start // 64 : start // 64 + 2].tobytes(), "little") >> start % 64
        return high << self.low_bits | low & (1 << self.low_bits) - 1


class Shard:
    """The bytes of one shard, read in place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        self.width, n, self.n_ids, low_bits, lows, highs, samples, _ = map(int, np.frombuffer(data, "<u8", 8, 8))
        at = 72
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        at += 9 * n
        parts = []
        for size in (lows, highs, samples):
            parts.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        self.bounds = EliasFano(n + 1, low_bits, *parts)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document i of the shard, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def shard_bytes(doc_ids: list[int | None], documents: list[bytes], width: int) -> bytes:
    """documents: the ids of each, as little-endian unsigned integers of `width` bytes."""
    ends = np.concatenate([[0], np.cumsum([len(d) // width for d in documents])]).astype(np.int64)
    ef = EliasFano.build(ends)
    head = np.array([width, len(documents), int(ends[-1]), ef.low_bits, len(ef.low), len(ef.high), len(ef.samples), 0], "<u8")
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    nulls = bytes(i is None for i in doc_ids)
    return b"".join([MAGIC, head.tobytes(), ids.tobytes(), nulls, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), *documents])


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizer files name each byte: printable Latin-1 characters name themselves, the
    rest take the letters from U+0100 on, in order."""
    named = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(named)]
    return {b: chr(b) for b in named} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words as bytes; a word that is missing is merged by the library's model. A full table is emptied into an
    older one, whose entries come back when used."""

    def __init__(self, model, kind: str, room: int):
        self.model, self.kind, self.room, self.older, self.letters = model, kind, room, {}, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        made = self.older.get(word)
        if made is None:
            named = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            made = array(self.kind, [t.id for t in self.model.tokenize(named)]).tobytes()
        self[word] = made
        return made


class WordEncoder:
    """Ids of texts for a tokenizer whose pre-tokens are lower-cased matches of a pattern in NFC text, each merged alone.

    Texts with uncommon characters, whose lower case or composition may depend on more than the character, and texts
    with strings of added tokens go to the library whole; so do all texts if the tokenizer file does not say that it works
    this way.
    """

    #: The normalizer and split of a tokenizer file for which lower() and SPLIT stand.
    FILE_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    FILE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
    #: That split as it reads in texts of common characters.
    SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str, width: int, cache: int = 300_000):
        self.tokenizer, self.kind = load_tokenizer(path), {2: "H", 4: "I"}[width]
        self.special, self.words = special_pattern(self.tokenizer), WordIds(self.tokenizer.model, self.kind, cache)
        if (largest := max(self.tokenizer.get_vocab().values(), default=0)) >= 256**width:
            raise ValueError(f"ids up to {largest} do not fit in {width} bytes")
        with open(path, encoding="utf-8") as f:
            self.by_words = self.works_by_words(json.load(f))

    @classmethod
    def works_by_words(cls, made: dict) -> bool:
        """Whether a tokenizer file has the known normalizer and split, then byte-level merges of each word."""
        split, *rest = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        return ((made.get("normalizer") or {}).get("normalizers") == cls.FILE_NORMALIZER and split.get("pattern") == {"Regex": cls.FILE_SPLIT}
                and split.get("behavior") == "Removed" and split.get("invert") is True and made["model"]["type"] == "BPE"
                and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)])

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words or UNCOMMON.search(text) or self.special is not None and self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(text.lower())))


def word_encoder(path: str, width: int) -> WordEncoder:
    """One for each worker process, so that later tasks find the cache filled."""
    return worker_state("word-ids", (path, width), lambda: WordEncoder(path, width))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, width: int = 2, shard_ids: int = 8_000_000,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, end_id after each, as shards in `folder`; returns (file, n_docs, n_ids), one row a shard.

    Shards in order of their names hold the documents in ascending order of (doc_id, hash of the text), nulls first. A
    shard is closed when it has shard_ids ids or more, so a task holds one shard at most. A shard is written under a
    name of its own and renamed when complete, in place of one that an earlier run of the task left. Rows that are repeated
    very often are equal, so they are dealt to several ranges by their place in the input. An id that does not fit in
    `width` bytes is an error.
    """
    end = int(end_id).to_bytes(width, "little")
    rows = id_text(docs, id_col, text_col).withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        encoder, part, made = word_encoder(tokenizer_path, width), TaskContext.get().partitionId(), []
        ids, documents, size = [], [], 0

        def close():
            name = f"part-{part:08d}-{len(made):08d}.tlef"
            where.create_dir(base, recursive=True)
            with where.open_output_stream(draft := f"{base}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(shard_bytes(ids, documents, width))
            if where.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:  # not every file system replaces it
                where.delete_file(f"{base}/{name}")
            where.move(draft, f"{base}/{name}")
            made.append((name, len(documents), size // width))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                documents.append(encoder.encode(text or "") + end)
                size += len(documents[-1])
                if size >= shard_ids * width:
                    close()
                    ids, documents, size = [], [], 0
        if documents:
            close()
        yield pa.RecordBatch.from_pydict({"file": [m[0] for m in made], "n_docs": [m[1] for m in made], "n_ids": [m[2] for m in made]},
                                         schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return written(rows.mapInArrow(run, "file string, n_docs long, n_ids long"), "manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the shards by the boundaries that select gives: start
    counts the ids of all documents before it, ids_crc32 is over its ids as little-endian unsigned 32-bit integers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tlef").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for k in range(batch.num_rows):
                shard, name = Shard(batch.column(1)[k].as_py()), os.path.basename(batch.column(0)[k].as_py())
                for first in range(0, len(shard.doc_ids), 4096):
                    own = range(first, min(first + 4096, len(shard.doc_ids)))
                    starts = [shard.bounds.select(i) for i in range(own.start, own.stop + 1)]
                    crcs = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(starts, starts[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(own), pa.string()), pa.array(shard.doc_ids[own.start : own.stop], mask=shard.nulls[own.start : own.stop].astype(bool)),
                        pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    found = files.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    base = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(base, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **how) -> DataFrame:
    """Writes the shards, to the shared folder if none is given, and returns what read_token_files finds in them.

    A null or empty text is the end id alone. Repeated rows are documents of their own; null ids come first and are read
    back as null; an empty table writes no shard and returns no row. Other columns are not read. The folder has to be
    one that all executors share.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer_path, end_id, **how)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
