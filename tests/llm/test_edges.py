"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.llm import bpe, chat, decontaminate, html_text, jaccard, language, quality, token_counts, token_files, toxicity

SCHEMA = "doc_id long, text string, tokens array<int>, n long, rep string, key string, score double, component string"
WORDS = "the quick brown fox jumps over the lazy dog and runs away from every hound it meets today"
TEXTS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (5, " \n\t "), (None, WORDS), (6, "x" * 50_000), (7, "a b c " * 20_000), (8, "é漢字🙂 </s> <|endoftext|> \x00"), (9, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [1], 1, "r", "k", 0.5, "c") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def operators(spark):
    path = public_tokenizers.path
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, "lazy dog")], "item_id long, text string")
    taught = spark.createDataFrame([(i, text, lang) for i, (text, lang) in enumerate([(WORDS, "en"), ("der schnelle braune Fuchs springt über den faulen Hund", "de"), (None, "en"), ("", "de"), ("x", None)])],
                                   "doc_id long, text string, lang string")
    model = language.learn_languages(taught)
    machine = toxicity.learn_toxicity(taught, spark.createDataFrame([(0, 0), (1, 1), (2, 1), (None, 0)], "doc_id long, toxic int"))
    return {
        "decontaminate": lambda d: decontaminate.contained_items(d, items),
        "language": lambda d: language.identify_language(d, model),
        "tokens": lambda d: token_counts.count_tokens(d, path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
        "quality": lambda d: quality.quality_rules(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, machine),
        "html": lambda d: html_text.extract_text(d.withColumn("url", F.concat(F.lit("http://r.example/"), F.coalesce("doc_id", F.lit(0)).cast("string"))), "doc_id", "url", "text"),
        "files": lambda d: token_files.token_files(d, path("word_bpe_49k.json"), 2),
        "bpe": lambda d: bpe.round_trip(d, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "jaccard": lambda d: jaccard.jaccard_components(d),
    }


@pytest.mark.parametrize("name", ["decontaminate", "language", "tokens", "quality", "toxicity", "html", "files", "bpe", "jaccard"])
def test_edges(operators, docs, name):
    rows = operators[name](docs).collect()
    if name == "decontaminate":
        assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 1), (0, 4), (1, 1), (1, 4), (2, 1), (2, 1), (2, 4), (2, 4)]
    else:
        key = "page_id" if name == "html" else "doc_id"
        assert sorted(str(r[key]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert operators[name](docs.limit(0)).collect() == []


def test_jaccard_of_repeated_and_empty_texts(operators, docs):
    got = {r.doc_id: r.component_id for r in operators["jaccard"](docs).collect()}
    assert got[1] == got[2] == 1 and all(got[i] == i for i in (3, 4, 5, 6, 7, 8, 9))


def test_repeated_messages_count_once_and_long_and_clashing_ones_stay(spark):
    rows = [(1, m, m - 1 if m else None, "user" if m % 2 == 0 else "assistant", "t" * (200_000 if m == 3 else 3), 0.0, "leaf") for m in range(6)]
    messages = spark.createDataFrame(rows * 2 + [(1, 4, 3, "user", "zzz", 0.0, "x")], "conv_id long, msg_id long, parent_id long, role string, text string, score double, leaf string")
    out = chat.format_paths(messages)
    (row,) = out.select("conv_id", "leaf", chat.parse_turns(out.formatted).alias("turns")).collect()
    assert (row.leaf, [(t.role, t.text) for t in row.turns]) == (5, [r[3:5] for r in rows])


def test_a_very_long_word_keeps_the_transducer_in_bounds(encoder, reference):
    import random

    rng = random.Random(9)
    machine = bpe.Transducer(encoder.machine.ranks, max_moves=2_000)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    assert list(machine.encode(word.encode())) == reference.encode_ordinary(word) and len(machine.moves) <= 2_000


def test_another_tokenizer_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    made = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    made["normalizer"]["normalizers"].pop()  # keeps capitals
    path = str(tmp_path / "own.json")
    json.dump(made, open(path, "w"))
    assert not token_files.WordEncoder(path, 2).by_words and token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2).by_words
    library, text = Tokenizer.from_file(path), "Capitals STAY here"
    assert token_files.WordEncoder(path, 4).encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
    made["model"]["vocab"]["much-too-far"] = 1 << 17
    json.dump(made, open(path, "w"))
    with pytest.raises(ValueError, match="do not fit"):
        token_files.WordEncoder(path, 2)


def test_reply_tree_gives_a_conversation_a_leaf(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a</s>\\", 2.0), (1, 3, 1, "assistant", None, 1.0), (1, 4, 2, "user", "<|end|>", 0.0), (2, 1, 9, None, "x", None), (None, 1, None, "user", "y", 1.0)]
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat.format_paths(messages)
    turns = {(r.conv_id, r.leaf): [(t.role, t.text, t.target) for t in r.turns] for r in out.select("conv_id", "leaf", chat.parse_turns(out.formatted).alias("turns")).collect()}
    assert turns == {(1, 4): [("user", "hi", False), ("assistant", "a</s>\\", True), ("user", "<|end|>", False)], (1, 3): [("user", "hi", False), ("assistant", "", True)], (2, 1): [("", "x", False)]}
    assert {r.leaf: r.path_rank for r in out.collect() if r.conv_id == 1} == {4: 1, 3: 2}
    assert chat.format_paths(messages.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    import numpy as np

    values = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
    coded = token_files.EliasFano.build(values)
    assert [coded.select(i) for i in range(len(values))] == values.tolist()


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.machine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdehilnorst'! \n0", max_size=120)))
def test_transducer_is_the_library(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = reference.encode_ordinary(text)
    assert list(map(int, encoder.encode(text).split())) == ids
    stream = bpe.Utf8Stream(encoder.machine.names)
    assert b"".join([*(stream.feed([i]) for i in ids), stream.end()]) == text.encode()


def test_factors_learn_a_pair_that_neither_term_shows():
    import numpy as np

    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 2, (4000, 2))
    rows = [np.flatnonzero([1, 0, a, b]).astype(np.int32) for a, b in pairs]
    labels = (pairs.sum(1) == 2).astype(float)
    machine = toxicity.fit_machine(rows, labels, epochs=40)
    z = lambda ids: machine.bias + machine.weights[ids].sum() + 0.5 * ((machine.factors[ids].sum(0) ** 2).sum() - (machine.factors[ids] ** 2).sum())
    assert z([0, 2, 3]) > 0 > max(z([0, 2]), z([0, 3]), z([0]))


def tables_left(spark):
    import os

    from trendloom.session import shared_root

    root = shared_root(spark).removeprefix("file:")
    return {d for d in os.listdir(root) if d.startswith("trendloom-")}


def test_tables_made_on_the_way_are_gone_at_the_end(spark, sf):
    """Each query leaves the one table that its result reads, at most, and the pipeline the input of its last stage."""
    import corpus_pipeline
    from trendloom.llm import queries

    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        before = tables_left(spark)
        query(spark, sf)
        assert len(tables_left(spark) - before) <= (2 if name == "op8_token_files" else 1), name  # files, and the list of them


def test_stages_keep_columns_whose_names_are_used_inside(spark, sf):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    docs = docs.withColumns({"_row": F.lit("mine"), "at": F.lit(1.5), "digest": F.col("doc_id") + 1})
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and {r._row for r in kept.collect()} == {"mine"} and all(r.digest == r.doc_id + 1 for r in kept.collect())
