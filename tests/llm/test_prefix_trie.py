"""The trie of prefixes against a plain version in Python."""

import hashlib
import random
import re
import zlib

import pytest

from trendloom.llm.prefix_trie import conversation_trie, list_digests

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, every=None):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = own
    if every:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        built = {c: own.get(c - c % every, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * words
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], digest([c for c in m if len(built[c]) == len(n)]))
                   for n, m in members.items()), key=repr)


def found(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in conversation_trie(df, **how).select(*COLUMNS).collect()), key=repr)


def random_rows(seed, conversations=120):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for turn in range(r.choice([0, 1, 2, 2, 3, 5, 9])):
            rows.append((c - 20, r.choice([turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["", "a b", "a  c\n", None, "é  x", "user"])))
    return rows


@pytest.mark.parametrize("seed,every", [(1, None), (2, 20), (3, 20), (4, 7)])
def test_random_tries(spark, seed, every):
    rows = [x for x in random_rows(seed) if not every or x[0] >= 0]
    assert found(spark, rows, shared_every=every) == plain(rows, every)


def test_edges(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    # repeated rows are turns of their own; a null role or text is as good as an empty one; ids may be null
    rows = [(1, 0, "user", "x y"), (1, 0, "user", "x y"), (2, 0, "user", "x y"), (2, None, None, None), (3, None, "", ""), (None, 0, "user", "z")]
    assert found(spark, rows) == plain(rows)
    # where role and text meet is part of a turn
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "1:a", "bc")]
    assert len(found(spark, rows)) == 4
    # conversation 1 has h = 3 turns to take over, none of its own left and none there to take: a member of the root alone
    rows = [(1, 0, "user", "x"), (41, 0, "user", "x"), (41, 1, "user", "y"), (41, 2, "user", "y"), (41, 3, "user", "y")]
    assert found(spark, rows, shared_every=20) == plain(rows, 20)
    extra = [(*r, b"k", 5, "p", 1.5) for r in rows]
    assert found(spark, extra, SCHEMA + ", digest binary, depth long, parent string, words double") == plain(rows)


def test_large_groups_and_long_conversations(spark):
    """Copies share one long path; one conversation is far longer than all others; a first turn has very many followers."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    rows += [(1000, t, "user", f"turn {t} of many") for t in range(3000)]
    rows += [(c, t, "user", "hello" if t == 0 else f"I am {c}") for c in range(2000, 4500) for t in range(2)]
    got = found(spark, rows)
    assert len(got) == 1 + 6 + 3000 + 1 + 2500
    assert (0, 6, 0, 300, 0, 1, 299 * 2, hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()) in got
    assert (2000, 1, 0, 2500, 2500, 2500, 2499, hashlib.sha256(b"").hexdigest()) in got
    total = sum(299 * 2 for _ in range(6)) + 2499
    assert (0, 0, None, 2801, 3, 2502, total, hashlib.sha256(b"").hexdigest()) in got


def test_lists_over_many_rows(spark):
    r = random.Random(5)
    rows = [(bytes([k]), c) for k, n in ((1, 5000), (2, 1), (3, 700)) for c in r.sample(range(-10_000, 10_000), n)]
    want = {k: hashlib.sha256(",".join(map(str, sorted(c for x, c in rows if x == k))).encode()).hexdigest() for k in {x for x, _ in rows}}
    df = spark.createDataFrame(rows, "digest binary, conv_id long").repartition(9)
    assert {bytes(x.digest): x.ends_sha256 for x in list_digests(df).collect()} == want
