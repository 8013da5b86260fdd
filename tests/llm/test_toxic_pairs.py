"""Pairs of terms that only together tell, among terms that say nothing."""

import numpy as np
import pytest

from trendloom.llm import toxicity


def score(machine, ids):
    v = machine.factors[ids]
    return machine.bias + machine.weights[ids].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())


@pytest.mark.parametrize("equal", [True, False])
def test_pair_of_terms_that_are_as_frequent_in_clean_rows(equal):
    """Toxic where both terms stand or neither; then toxic where just one does, so that the pair tells a clean text."""
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 2, (4000, 2))
    labels = ((pairs[:, 0] == pairs[:, 1]) == equal).astype(float)
    for bit in (0, 1):  # each term as frequent in toxic and clean rows
        assert abs(pairs[labels == 1, bit].mean() - pairs[labels == 0, bit].mean()) < 0.05
    rows = [np.concatenate([np.flatnonzero(p), np.sort(rng.choice(300, 15, replace=False)) + 10]).astype(np.int32) for p in pairs]
    assert not toxicity.telling_buckets(rows, labels, 1 << 18, 5, 10.0)[[0, 1]].any()
    machine = toxicity.fit_machine(rows, labels, epochs=40)
    sign = 1 if equal else -1
    assert min(sign * score(machine, [0, 1]), sign * score(machine, [])) > 0 > max(sign * score(machine, [0]), sign * score(machine, [1]))
    linear = toxicity.fit_machine(rows, labels, epochs=40, rank=0)
    assert not all((score(linear, list(np.flatnonzero(p))) > 0) == (p[0] == p[1]) == equal for p in ([0, 0], [0, 1], [1, 0], [1, 1]))


def test_ids_near_the_limit_null_ids_and_repeated_rows(spark):
    top = 2**63 - 1
    texts = [(top - i, "awful insult group" if i % 2 else "kind words group") for i in range(40)] + [(None, "awful insult"), (top, "kind words group"), (-top, None), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(top - i, i % 2) for i in range(40)] + [(top, 0), (None, 1), (-top, None)], "doc_id long, toxic int")
    machine = toxicity.learn_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, machine).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0.5) == bool((top - r.doc_id) % 2) for r in rows if r.doc_id and r.doc_id > 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels)).collect() == []
