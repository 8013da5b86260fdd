"""The divergence audit against a plain version in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trendloom.llm import divergence
from trendloom.llm.divergence import block_counts, scaled, source_divergence, term_slices

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least_docs, top=50, pseudo=5):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [Counter(TERM.findall(lower(t))) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, c) for (x, s, _), c in zip(rows, terms) if x == lang]
        kept = {t for t, n in Counter(t for _, c in own for t in c).items() if n >= least_docs}
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + pseudo) // (sum(c.values()) + pseudo * len(kept)) for t in kept} for s, c in [*counts.items(), (None, whole)]}
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            most = [(p[None][t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(most, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, columns="lang string, source string, text string", **how):
    return sorted(map(tuple, source_divergence(spark.createDataFrame(rows, columns), **how).select("lang", "source", "part", "item", "value", "rank").collect()))


def random_rows(n, seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "café", "CAFÉ", "x1y", "naïve", "日本", "日本語", "don't", "Zz", "zz", "ʼ", "Ａ", " ", "é"]
    return [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None]), None if r.random() < 0.1 else r.choice([" ", "\n", "\0", "--"]).join(r.choices(words, k=r.randrange(12)))) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_all_rows_against_plain_version(spark, partitions):
    rows = random_rows(300, 1)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(partitions)
    got = sorted(map(tuple, source_divergence(df, least_docs=5, top=3).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(rows, 5, 3)
    assert {r[2] for r in got} == {"pair", "term"}


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    # without a kept term every pair has value 0, ranked by name
    rows = [("en", "b", "one"), ("en", "a", ""), ("en", None, None), ("de", "a", "x")]
    assert found(spark, rows) == plain(rows, 30) and len(found(spark, rows)) == 6
    # repeated rows are documents of their own; ties go by item; extra columns with the names used inside change nothing
    rows = [("en", "a", "same word"), ("en", "a", "same word"), ("en", "b", "other"), ("en", "b", "other")]
    extra = [(*r, 1, "t", 2, [1], 7) for r in rows]
    assert found(spark, extra, "lang string, source string, text string, n int, term string, docs int, entries array<int>, rank int", least_docs=2) == plain(rows, 2)


def test_long_text_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICES", 1000)
    r = random.Random(3)
    rows = [("en", f"s{i % 37}", " ".join(r.choices([f"w{chr(97 + k)}" for k in range(26)], k=20))) for i in range(200)] + [("en", "s1", "wa wb " * 60_000)]
    assert found(spark, rows, least_docs=3) == plain(rows, 3)


def test_blocks_and_colliding_digests():
    rows = random_rows(200, 2)
    columns = [pa.array([x or "" for x in c], pa.string()) for c in zip(*rows)]
    want = Counter()
    for lang, source, text in rows:
        want.update({(lang or "", source or "", t): n for t, n in Counter(TERM.findall(lower(text or ""))).items()})
    for digest in (divergence.xxhash.xxh3_64_intdigest, lambda b: len(b) % 3):
        got = block_counts(*columns, digest)
        rows_of = {(r["lang"], r["source"], r["term"].decode()): r["n"] for r in got.to_pylist() if r["term"]}
        assert rows_of == want and got.num_rows == len(want) + len({(a or "", b or "") for a, b, _ in rows})


def test_terms_never_cross_texts():
    texts = ["ab", "", "cd1ef", "é", "", "\0"]
    joined = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    a, b = term_slices(np.frombuffer(joined, np.uint8), offsets)
    assert [joined[i:j].decode() for i, j in zip(a, b)] == ["ab", "cd", "ef", "é"]


def test_scaled_counts_are_exact():
    for count, total, terms in [(0, 0, 1), (3, 10, 4), (10**15, 3 * 10**15, 10**6), (2 * 10**15, 2 * 10**15 + 1, 17)]:
        assert scaled(np.array([count]), total, 5, terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)
