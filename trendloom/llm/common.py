"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters with their marks, in any script; and what that is in texts of common characters, for the faster engine.
LETTERS, COMMON_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(r"[^\W\d_]+")
#: Runs of letters and digits, in any script.
ALNUM = re.compile(r"[^\W_]+")
#: Words as the corpus contracts define them: runs of anything but ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Finds a character outside of Latin letters, ASCII digits, common punctuation and plain white space. In texts without
#: one, the standard library's \\w, \\d and \\s mean letters and digits and white space exactly as Unicode's classes do.
UNCOMMON = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


def letter_runs(text: str) -> list[str]:
    """The words of a text as runs of letters (Unicode's class L) with their marks, lower-cased."""
    return (LETTERS if UNCOMMON.search(text) else COMMON_LETTERS).findall(text.lower())


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever other columns there are, so that no name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def crc_residue(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_col.cast("string")) % modulus


def hash_sample(df: DataFrame, bound: int, salt: int, by: str | None = None) -> DataFrame:
    """About `bound` rows (all, if there are fewer), with `by` about that many of each of its values, which have to be few.

    A hash of the whole row picks them, so they are the same on every run and partitioning, and rows that share an id, or
    have none, don't come all together. Equal rows of a sample count once, so that it stays bounded.
    """
    counts = df.groupBy(*[by] if by else []).count().collect()
    if all(r["count"] <= bound for r in counts):
        return df
    cells = 1 << 30
    part = F.pmod(F.xxhash64(F.lit(salt), *df.columns), F.lit(cells))
    keep = F.lit(False)
    for r in counts:
        own = F.col(by).eqNullSafe(F.lit(r[by])) if by else F.lit(True)
        keep = keep | own & (part < int(min(1, bound / r["count"]) * cells))
    return df.filter(keep).distinct()


_owner = None
_states: dict = {}


def give_back_memory() -> None:
    """Returns freed memory to the system, so that a worker doesn't stay as large as its largest task so far."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def worker_state(owner, name, make: Callable):
    """What `make` gave when this worker process was first asked for (owner, name); later tasks find it filled.

    A worker keeps the states of one owner at a time, so that the operators of a pipeline don't add up in its memory.
    """
    global _owner
    if owner != _owner:
        _states.clear()
        give_back_memory()
        _owner = owner
    if name not in _states:
        _states[name] = make()
    return _states[name]


def map_texts(docs: DataFrame, schema: str, make: Callable[[], Callable[[list, list], dict]], rows: int = 1024) -> DataFrame:
    """Applies a batch function to (ids, texts) in every task, to `rows` rows at a time at most.

    `make` runs once a task and returns the function, which gets the batch's ids and texts (null text: None) and
    returns the columns of `schema` in order as lists or arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = apply(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        give_back_memory()

    return docs.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text", rows: int = 1024) -> DataFrame:
    """The rows of docs, with all their columns, for whose text a batch function says so. Each row is judged by itself, so ids
    that are null or repeated make no difference. `make` runs once a task and returns the function from texts to booleans."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        give_back_memory()

    return docs.mapInArrow(run, docs.schema)
