"""The corpus pipeline: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.bpe import round_trip
from trendloom.llm.decontaminate import drop_contaminated
from trendloom.llm.jaccard import jaccard_components
from trendloom.llm.language import keep_known_languages, learn_outside_fold
from trendloom.llm.quality import keep_good
from trendloom.session import Workspace, remove, shared_path, write_to, written

#: Near copies in a corpus: shingles of five words, similarity in percent. The query op10_jaccard has its own, 4 and 85.
NEAR_WIDTH, NEAR_PERCENT = 5, 80

#: Least score of a language: below, no language is ahead of all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which no language can be told, each by its own text."""
    return keep_known_languages(docs, learn_outside_fold(docs), LEAST_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the quality rules reject, each by its own text, by limits learned from all of docs."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, of those with the smallest id; null ids come after all others.

    Rows are told apart by a number of their own, so rows that share an id, or have none, are compared as any others.
    """
    row = next(x for x in ("_row" + "_" * n for n in range(len(docs.columns) + 1)) if x.lower() not in map(str.lower, docs.columns))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    with Workspace(spark, "copies") as space:
        found = space.written(jaccard_components(rows, NEAR_WIDTH, NEAR_PERCENT, id_col=row).withColumnRenamed("doc_id", "at"), "components")
        own = found.join(rows.select(F.col(row).alias("at"), "doc_id"), "at")
        first = own.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("x"))
        gone = space.finish(found.select("at").join(first.select(F.col("x.at").alias("at")), "at", "left_anti"))
    return rows.join(gone, F.col(row) == gone["at"], "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that contain a benchmark item, each by its own text."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with their number and the digests of them and of what they decode to."""
    # fewer moves kept than alone: the executors still hold the memory of the stages before
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=200_000, max_moves=120_000, with_ids=True)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Language scores, compression ratios and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables made on the way only the last stage's input stays, which the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with Workspace(spark, f"{name}-run"):  # a stage's own tables go when its result stands
            docs = write_to(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before.rsplit("/", 1)[0])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
