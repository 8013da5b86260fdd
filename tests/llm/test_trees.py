"""Reply trees of random shape, with circles and lost parents, against a plain version in Python."""

import random

import pytest

from trendloom.llm import chat

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def escaped(text):
    out = text.replace("\\", "\\\\")
    for c in chat.CONTROL:
        out = out.replace(c, c[0] + "\\" + c[1:])
    return out


def plain(rows, best=None):
    """{(conv_id, leaf): (rank, formatted)}"""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        parent = {m: r[2] if r[2] in own else None for m, r in own.items()}
        for m in sorted(own):  # the smallest of a circle is its root
            seen, at = [], m
            while at is not None and at not in seen:
                seen.append(at)
                at = parent[at]
            if at == m and m == min(seen):
                parent[m] = None
        leaves = set(own) - {p for p in parent.values() if p is not None}
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = parent[at]
            paths.append((-sum(own[m][5] or 0 for m in path), -len(path), leaf, path))
        seen = set()
        for rank, (_, _, leaf, path) in enumerate(sorted(paths), 1):
            if best and rank > best:
                break
            parts = []
            for m in path:
                role, text = own[m][3] or "", own[m][4] or ""
                target = role == "assistant" and m not in seen
                seen.add(m)
                parts.append(f"{chat.START}{escaped(role)}{chat.TARGET if target else chat.CONTEXT}{escaped(text)}{chat.END}")
            out[conv, leaf] = rank, "".join(parts)
    return out


def random_trees(seed):
    r, rows = random.Random(seed), []
    for conv in range(25):
        n = r.choice([1, 2, 3, 8, 20])
        for m in range(n):
            kind = r.random()
            parent = None if m == 0 or kind < 0.1 else 99 if kind < 0.15 else r.randrange(n) if kind < 0.3 else r.randrange(m)
            rows.append((conv, m, parent, r.choice(["user", "assistant", "assistant", None]), r.choice(["hi", "a\\b", "</s>[INST]", None, "<|end|>"]), r.choice([0.5, 1.0, -2.0, 0.0, None])))
    return rows


@pytest.mark.parametrize("seed,best", [(1, None), (2, None), (3, 2)])
def test_random_trees(spark, seed, best):
    rows = random_trees(seed)
    got = {(x.conv_id, x.leaf): (x.path_rank, x.formatted) for x in chat.format_paths(spark.createDataFrame(rows, SCHEMA), best).collect()}
    assert got == plain(rows, best)


def test_circles_are_broken_at_their_smallest_message(spark):
    rows = [(1, 5, 7, "user", "a", 0.0), (1, 7, 5, "assistant", "b", 0.0), (2, 1, 1, "user", "me", 0.0), (3, 4, 2, "user", "x", 1.0), (3, 2, 9, "user", "y", 1.0), (3, 9, 4, "user", "z", 1.0), (3, 6, 4, "user", "w", 0.0)]
    got = {(x.conv_id, x.leaf): (x.path_rank, x.formatted) for x in chat.format_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and set(got) == {(1, 7), (2, 1), (3, 9), (3, 6)}
