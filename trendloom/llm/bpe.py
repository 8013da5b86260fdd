"""Byte-level BPE by a finite-state transducer, and streaming decoding.

The merges are compiled into a trie of the vocabulary. Of every prefix of a pre-token there is exactly one tokenization
that the merges give, and it ends with the one token that can follow the tokenization of what stands before it. So a
state of the transducer is the set of places where a token that is still being read may have started: for each, the
node of the trie, the token before it, and the tokens that are not written yet. Reading a byte moves all places at
once; tokens on which all places agree are written. A place lives no longer than the longest token, which bounds the
lookahead. States and moves are made when they are first needed and kept up to a bound, within a pre-token as between two.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from trendloom.llm.common import UNCOMMON, id_text, map_texts, worker_state

#: A public split pattern, and what it means in texts of common characters, for the standard library's faster engine.
KNOWN_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMMON_SPLIT = r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Above every rank: no such pair.
NEVER = 1 << 60


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that the merges leave of data: the adjacent pair of least rank is joined, leftmost first, until none can be."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes pre-tokens. encode(piece) is the tuple of ids, as rank-ordered merges give them."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = 400_000, max_fits: int = 65_536):
        self.ranks, self.max_moves, self.max_fits = ranks, max_moves, max_fits
        self.names = {r: t for t, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, r in ranks.items():
            node = 0
            for b in t:
                below = self.children[node].get(b)
                if below is None:
                    below = self.children[node][b] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = below
            self.token[node] = r
        self.edges: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.restart()

    def restart(self, keep: tuple | None = None) -> int:
        """Forgets all states but the first, and one to go on from; returns the number of that."""
        start = ((0, -1, ()),)
        self.states, self.number, self.moves = [start], {start: 0}, {}
        if keep is None or keep == start:
            return 0
        self.states.append(keep)
        self.number[keep] = 1
        return 1

    def edge(self, token: int) -> tuple | None:
        """(first, last): the tokens that stand in turn at the first and at the last byte while the merges form `token`, with
        the ranks at which each gives way to the next. None if the merges do not form it."""
        if token in self.edges:
            return self.edges[token]
        name = self.names[token]
        parts, first, last, made = [name[i : i + 1] for i in range(len(name))], [], [], None
        first.append(self.ranks[parts[0]])
        last.append(self.ranks[parts[-1]])
        so_far, ascending = -1, True
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            ascending &= rank >= so_far
            so_far = rank
            if at == 0:
                first.append(rank)
            if at == len(parts) - 2:
                last.append(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1:
            made = (tuple(first), tuple(last), ascending)
        self.edges[token] = made
        return made

    def follows(self, before: int, token: int) -> bool:
        """As `fit` tells, from what is kept of it."""
        known = self.fits.get(before << 32 | token)
        if known is None:
            if len(self.fits) >= self.max_fits:
                self.fits.clear()
            known = self.fits[before << 32 | token] = self.fit(before, token)
        return known

    def fit(self, before: int, token: int) -> bool:
        """Whether the merges form `token`, and leave it beside `before` (-1: nothing) rather than join across.

        Where the merges inside of both run in the order of their ranks, as far as one side is formed by the time of a rank
        is told by its edge, so only the pairs that meet at the seam are looked at.
        """
        right = self.edge(token)
        if right is None or before < 0:
            return right is not None
        left, names, get = self.edge(before), self.names, self.ranks.get
        if not (left[2] and right[2]):
            return merge_bytes(names[before] + names[token], self.ranks) == [names[before], names[token]]
        a, b = left[1], right[0]
        i = j = 0
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else NEVER
            next_b = b[j + 1] if j + 1 < len(b) else NEVER
            across = get(names[a[i]] + names[b[j]], NEVER)
            if across < next_a and across <= next_b:  # of equal ranks the leftmost is joined first
                return False
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """Makes the move from a state on a byte: the next state, with the tokens written if there are any."""
        places, here = [], None
        for node, before, waiting in self.states[state]:
            below = self.children[node].get(byte)
            if below is None:
                continue
            t = self.token[below]
            if here is None and t >= 0 and self.follows(before, t):
                here = (0, t, (*waiting, t))
            if self.children[below]:
                places.append((below, before, waiting))
        if here is None:
            raise ValueError("the vocabulary lacks a single byte")
        places.append(here)
        waits = [p[2] for p in places]
        agreed, least, most = 0, min(waits), max(waits)  # what the first and the last in order agree on, all do
        shortest = min(len(least), len(most))
        while agreed < shortest and least[agreed] == most[agreed]:
            agreed += 1
        following = tuple([(node, before, waiting[agreed:]) for node, before, waiting in places] if agreed else places)
        number = self.number.get(following)
        if number is None:
            number = self.number[following] = len(self.states)
            self.states.append(following)
        made = self.moves[state << 8 | byte] = (number, here[2][:agreed]) if agreed else number
        return made

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out, get = 0, [], self.moves.get
        for byte in piece:
            made = get(state << 8 | byte)
            if made is None:
                if len(self.moves) >= self.max_moves:  # also inside of a piece, which may be very long
                    state, get = self.restart(self.states[state]), self.moves.get
                made = self.move(state, byte)
            if made.__class__ is int:
                state = made
            else:
                state, wrote = made
                out += wrote
        return (*out, *self.states[state][-1][2])


class Utf8Stream:
    """Decodes ids one batch after another; gives bytes back only up to the end of a code point.

    The state is how many continuation bytes the code point at the end still needs, with its bytes so far.
    """

    def __init__(self, names: dict[int, bytes]):
        self.names, self.held = names, b""

    @staticmethod
    def wanting(data: bytes) -> int:
        """How many bytes at the end of data begin a code point that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                needs = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3 if byte < 0xF8 else 0
                return back if needs >= back else 0
        return 0

    def feed(self, ids) -> bytes:
        data = self.held + b"".join(map(self.names.__getitem__, ids))
        cut = len(data) - self.wanting(data)
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        """What is left when no more ids come: bytes that are no whole code point."""
        held, self.held = self.held, b""
        return held


class TextEncoder:
    """Encodes texts: splits them by the pattern, looks pieces up in a bounded cache, and runs the transducer on the rest."""

    def __init__(self, path: str, pattern: str, cache: int = 200_000, max_moves: int = 400_000):
        self.machine, self.split, self.room = Transducer(load_ranks(path), max_moves), regex.compile(pattern), cache
        self.common = re.compile(COMMON_SPLIT) if pattern == KNOWN_SPLIT else None
        self.names = {str(i): t for i, t in self.machine.names.items()}  # by decimal id, as this encoder writes them
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def piece(self, piece: str) -> str:
        """Of a piece that is not in the cache. A full cache becomes the older one, whose entries come back when used."""
        if len(self.cache) >= self.room:
            self.older, self.cache = self.cache, {}
        made = self.older.get(piece)
        if made is None:
            made = " ".join(map(str, self.machine.encode(piece.encode("utf-8", "surrogatepass"))))
        self.cache[piece] = made
        return made

    def encode(self, text: str) -> str:
        """The decimal ids, joined by one space."""
        split = self.split if self.common is None or UNCOMMON.search(text) else self.common
        return " ".join([self.cache.get(p) or self.piece(p) for p in split.findall(text)])


def text_encoder(*how) -> TextEncoder:
    """One for each worker process, so that later tasks find the cache filled."""
    return worker_state("bpe", how, lambda: TextEncoder(*how))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row, without special tokens. A null or empty text has no ids. Repeated rows give repeated
    results, an empty table none; a null id stays null. Other columns are not read. The file has to be at the same path
    on every executor."""

    def make():
        encoder = text_encoder(ranks_path, pattern)
        return lambda ids, texts: {"doc_id": ids, "ids": [list(map(int, encoder.encode(t or "").split())) for t in texts]}

    return map_texts(id_text(docs, id_col, text_col), "doc_id long, ids array<int>", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", step: int = 4096,
               cache: int = 200_000, max_moves: int = 400_000, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids ids): encodes as encode_documents does, decodes the
    ids again in steps of `step`, and gives the digests of the decimal ids joined by one space and of the decoded bytes. cache
    and max_moves bound a worker's memory: pieces in each of two generations, and moves of the transducer; smaller ones cost
    time only."""

    def make():
        encoder = text_encoder(ranks_path, pattern, cache, max_moves)
        names = encoder.names

        def one(text):
            joined = encoder.encode(text)
            ids = joined.split(" ") if joined else []
            stream, digest = Utf8Stream(names), hashlib.sha256()
            for start in range(0, len(ids), step):
                digest.update(stream.feed(ids[start : start + step]))
            digest.update(stream.end())
            found = len(ids), hashlib.sha256(joined.encode()).hexdigest(), digest.hexdigest()
            return (*found, np.array(ids, np.int32)) if with_ids else found

        def apply(ids, texts):
            return {"doc_id": ids} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "ids"), zip(*[one(t or "") for t in texts])))

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(id_text(docs, id_col, text_col), schema, make)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
