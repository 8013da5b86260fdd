"""The stage's own setting, five words and 80 percent, against a brute force; and cells that are cut into blocks."""

import random

from test_queries import components, shingle_sets

import pytest

import corpus_pipeline
from trendloom.llm import jaccard


def test_stage_compares_five_words_at_80_percent(spark):
    rng, rows = random.Random(1), []
    words = [f"w{i}" for i in range(2000)]
    for n, changes in [(100, 1), (100, 2), (100, 3), (300, 4), (300, 6), (300, 9), (12, 0), (40, 1)] * 3:
        text = rng.choices(words, k=n)
        copy = text[:]
        for at in range(changes):
            copy[8 + at * (n - 16) // max(changes, 1)] = "other"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    want, strict = components(shingle_sets(rows, 5), 80), components(shingle_sets(rows, 4), 85)
    assert want != strict
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in want if want[i] == i]


def many_sets_of_one_cell(monkeypatch, chain):
    """Many sets that share one beginning: near copies of several texts, or a chain of sets each of which links with the next."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    common, texts = rng.choices(words, k=60), []
    if chain:
        for i in range(220):
            texts.append(common[:30] + [f"c{j}" for j in range(i, i + 30)])
    else:
        for own in range(6):
            body = common[:40] + [f"own{own}-{i}" for i in range(40)]
            for _ in range(50):
                copy = body[:]
                for at in rng.sample(range(40, 80), rng.choice([0, 1, 1, 2, 3])):
                    copy[at] = rng.choice(words)
                texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    monkeypatch.setattr(jaccard, "HOT", 10)
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs, width: jaccard.np.empty(0, jaccard.np.uint64))
    return rows


@pytest.mark.parametrize("chain", [False, True])
def test_cells_cut_into_blocks_give_the_same_components(spark, monkeypatch, chain):
    rows = many_sets_of_one_cell(monkeypatch, chain)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(shingle_sets(rows))
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, stars_later=0).collect()} == want


def all_links(rows):
    sets = {i: frozenset(x) for i, x in shingle_sets(rows).items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first[x] for x in first if x)
    links = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    return links, {i: (len(x), first[x] if x else None) for i, x in sets.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_join_gives_every_link_of_classes(spark, monkeypatch, hot):
    rows = many_sets_of_one_cell(monkeypatch, False)
    if not hot:
        monkeypatch.setattr(jaccard, "HOT", 10_000)
    rows += [(1000, rows[0][1]), (1001, ""), (1002, None), (1003, "two words"), (1004, "Two WORDS")]
    want, members = all_links(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:20]], "doc_id long, text string, a int")  # repeated rows, a name that clashes
    pairs, of = jaccard.jaccard_join(docs)
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(want) > 400 and sorted(found) == sorted(want)
    assert {r.doc_id: (r.n_shingles, r.rep) for r in of.collect()} == members and of.count() == len(rows) + 20


def test_join_of_the_documents_and_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, members = all_links([(r.doc_id, r.text) for r in docs.collect()])
    pairs, of = jaccard.jaccard_join(docs)
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want)
    assert {r.doc_id: (r.n_shingles, r.rep) for r in of.collect()} == members
    pairs, of = jaccard.jaccard_join(docs.limit(0))
    assert pairs.collect() == [] and of.collect() == []
    pairs, of = jaccard.jaccard_join(docs.limit(3).withColumn("doc_id", docs.doc_id * 0 + None))
    assert pairs.collect() == [] and [r.rep for r in of.collect()] == [None] * 3
