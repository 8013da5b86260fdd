"""What the learned operators do with small languages, rare scripts, skewed samples and large benchmarks."""

import numpy as np

from trendloom.llm import decontaminate, language, token_counts
from trendloom.llm.common import hash_sample, letter_runs


def test_words_are_letters_with_their_marks():
    assert letter_runs("½ ² Ⅷ 12 _ 🙂") == [] and letter_runs("हिन्दी Ünï-x1y") == ["हिन्दी", "ünï", "x", "y"]
    assert letter_runs("plain ASCII_words 3d") == ["plain", "ascii", "words", "d"]


def test_a_language_with_a_thousandth_of_the_rows_is_predicted(spark):
    rng = np.random.default_rng(2)
    spell = lambda letters: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(400)]
    large, small = spell("abcdefghij"), spell("klmnopqrst")
    text = lambda words: " ".join(rng.choice(words, 40))
    rows = [(i, text(large), "aa") for i in range(4000)] + [(4000 + i, text(small), "zz") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(docs, docs_a_language=500, words_a_language=100, grams_a_language=200)
    assert model.languages == ["aa", "zz"] and len(model.words) <= 200 and len(model.grams) <= 400
    asked = spark.createDataFrame([(1, text(small)), (2, text(large)), (3, "½ ² Ⅷ"), (4, None), (5, "qrst klmn")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(asked, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["zz", "aa", "und", "und", "zz"] and got[3][1] == 0
    empty = language.learn_languages(docs.limit(0))
    assert empty.languages == [] and {r.lang_pred for r in language.identify_language(asked, empty).collect()} == {"und"}


def test_samples_stay_bounded_when_ids_or_rows_repeat(spark):
    hot = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(id % 7 AS STRING) AS text")
    spread = spark.range(20_000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "CAST(id AS STRING) AS text")
    assert hash_sample(hot, 1000, 1).count() <= 7 and 700 < hash_sample(spread, 1000, 1).count() < 1300


def test_jobs_of_the_pre_token_table_do_not_grow_with_partitions(spark):
    import public_tokenizers

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 50, ' and more') AS text")
    made = []
    for n in (2, 40):
        spark.sparkContext.setJobGroup(f"pre-tokens-{n}", "")
        made.append(token_counts.frequent_lengths(docs.repartition(n), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, sample_docs=500))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pre-tokens-{n}")) <= 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made[0][0] == made[1][0] and made[0][1].tolist() == made[1][1].tolist()


def test_items_have_size_classes_and_repeated_ones_are_searched_once(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = {1: words[:8], 2: words[100:130], 3: words[200:900], 4: words[:3], 5: []}
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    hot = spark.range(1_000_000).selectExpr("id + 100 AS item_id", f"'{' '.join(words[100:130]).upper()}' AS text")
    distinct, ids = decontaminate.distinct_items(items.unionByName(hot), "item_id", "text")
    assert distinct.count() == 4 and ids.count() == 1_000_004
    index = decontaminate.SketchIndex([(r.item, r.words) for r in distinct.collect()], 5, 0.8)
    assert sorted(index.classes) == [(3, 1), (5, 3), (5, 5), (5, 10)]
    assert all(c.bound < np.uint64(2**63) for (k, n), c in index.classes.items() if n == 10)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:126])), (3, None)], "doc_id long, text string")
    many = items.unionByName(hot.filter("item_id < 110"))
    pairs = decontaminate.contained_items(docs, many, block_items=1).collect()
    assert sorted((r.doc_id, r.item_id) for r in pairs) == sorted([(1, i) for i in (1, 2, 3, 4, *range(100, 110))] + [(2, i) for i in (2, *range(100, 110))])
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, many, block_items=1).collect()] == [3]
