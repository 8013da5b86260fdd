"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by parent links. Self-joins that double the distance they span enumerate, for each leaf, the path
from its root; paths of a conversation are ranked by score, and each chosen path becomes one formatted conversation.
A turn is written as <|start|>ROLE<|message|>TEXT<|end|>, or with <|target|> for <|message|> where the text is under
the loss mask: an assistant message, in the best ranked path that holds it. Control strings inside roles and texts get
a backslash after their first character, and backslashes are doubled, so reading back gives the texts as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import Workspace

START, CONTEXT, TARGET, END = "<|start|>", "<|message|>", "<|target|>", "<|end|>"
#: Control strings of this and other public templates, as they may not stand in a text.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
#: Turns of a path that one task joins at once.
CHUNK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def enumerate_paths(messages: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, leaf, msg_id, dist) for every leaf and each message on the way to its root, dist links above the leaf.

    messages: (conv_id, msg_id, parent_id), msg_id unique in its conversation. A parent that does not exist makes its
    child a root. In a circle of parents the message with the smallest id is the root.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    real = nodes.join(nodes.select("conv_id", F.col("msg_id").alias("parent_id")), ["conv_id", "parent_id"], "left_semi")
    leaves = nodes.join(real.select("conv_id", F.col("parent_id").alias("msg_id")), ["conv_id", "msg_id"], "left_anti")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    up = real.select("conv_id", "msg_id", F.col("parent_id").alias("above"))
    # each round's rows are written, so that the plan of the next is a scan and no tree of joins
    parts = [space.written(leaves.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("dist")), "leaves")]
    links = None
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        before, links = links, space.written(up, f"above-{2**k}")
        if before is not None:
            space.drop(before)
        further = space.together(*parts).join(links, ["conv_id", "msg_id"]).select("conv_id", "leaf", F.col("above").alias("msg_id"), (F.col("dist") + 2**k).alias("dist"))
        parts.append(space.written(further, f"paths-{2**k}"))
        twice = links.select("conv_id", F.col("msg_id").alias("above"), F.col("above").alias("top"))
        up = links.join(twice, ["conv_id", "above"]).select("conv_id", "msg_id", F.col("top").alias("above"))
    if not up.isEmpty():  # someone is further above than a conversation has messages
        return enumerate_paths(without_circles(nodes, most, space), space)
    paths = space.together(*parts)
    roots = nodes.join(real.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti").select("conv_id", "msg_id")
    rooted = paths.join(roots, ["conv_id", "msg_id"], "left_semi").select("conv_id", "leaf")
    return paths.join(rooted, ["conv_id", "leaf"], "left_semi")


def without_circles(nodes: DataFrame, most: int, space: Workspace) -> DataFrame:
    """(conv_id, msg_id, parent_id) where the smallest message of each circle has no parent.

    Links that double the distance they span, each with the smallest id on its way, go on until they are longer than any
    circle: what stands above then is in a circle, and a message of one has met all of it.
    """
    links = nodes.filter("parent_id is not null").select("conv_id", "msg_id", F.col("parent_id").alias("above"), F.least("msg_id", "parent_id").alias("least"))
    for k in range(math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        links = space.written(links, f"around-{2**k}")
        twice = links.select("conv_id", F.col("msg_id").alias("above"), F.col("above").alias("top"), F.col("least").alias("further"))
        links = links.join(twice, ["conv_id", "above"]).select("conv_id", "msg_id", F.col("top").alias("above"), F.least("least", "further").alias("least"))
    links = space.written(links, "around")
    inside = links.select("conv_id", F.col("above").alias("msg_id")).distinct()
    first = links.join(inside, ["conv_id", "msg_id"], "left_semi").filter("msg_id = least").select("conv_id", "msg_id", F.lit(True).alias("cut"))
    return space.written(nodes.join(first, ["conv_id", "msg_id"], "left").select("conv_id", "msg_id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id")), "cut")


def one_row_a_message(messages: DataFrame) -> DataFrame:
    """Of rows with the same conv_id and msg_id the first in order of parent_id, role, text and score."""
    rest = [c for c in messages.columns if c not in ("conv_id", "msg_id")]
    return messages.groupBy("conv_id", "msg_id").agg(F.min(F.struct(*rest)).alias("x")).select("conv_id", "msg_id", "x.*")


def format_paths(messages: DataFrame, paths_per_conversation: int | None = None, ids_are_unique: bool = False) -> DataFrame:
    """(conv_id, leaf, path_rank, formatted) for each chosen path of each conversation.

    messages: conv_id, msg_id, parent_id, role, text, score; other columns are not read. A null role or text counts as
    empty, a null score as 0. A circle of parents is broken at its smallest msg_id. Paths rank by their summed score, then by length, longest first, then by leaf. Rows with
    a null conv_id or msg_id have no place in a tree and are left out; an empty table gives none. Of rows that repeat a
    msg_id of their conversation one counts (one_row_a_message); ids_are_unique says that there are none. One conversation
    is one output string, so a path has to fit in a row.
    """
    with Workspace(messages.sparkSession, "formatted") as space:
        return space.finish(chosen_paths(messages, paths_per_conversation, ids_are_unique, space))


def chosen_paths(messages: DataFrame, paths_per_conversation: int | None, ids_are_unique: bool, space: Workspace) -> DataFrame:
    """What format_paths returns, not yet written; its own tables stand in `space`."""
    own = messages.filter("conv_id is not null and msg_id is not null").select(
        "conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    own = space.written(own if ids_are_unique else one_row_a_message(own), "messages")
    steps = space.written(enumerate_paths(own, space).join(own.select("conv_id", "msg_id", "score", (F.col("role") == "assistant").alias("answers")), ["conv_id", "msg_id"]), "steps")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("turns"), "leaf")
    ranked = steps.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("turns"))
    ranked = ranked.select("conv_id", "leaf", F.row_number().over(order).alias("path_rank"))
    if paths_per_conversation is not None:
        ranked = ranked.filter(F.col("path_rank") <= paths_per_conversation)
    steps = steps.join(ranked, ["conv_id", "leaf"])
    first = steps.filter("answers").groupBy("conv_id", "msg_id").agg(F.min("path_rank").alias("first_rank"))
    steps = steps.join(first, ["conv_id", "msg_id"], "left").join(own.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"])
    mark = F.when(F.col("path_rank") == F.col("first_rank"), F.lit(TARGET)).otherwise(F.lit(CONTEXT))
    piece = F.concat(F.lit(START), escape(F.col("role")), mark, escape(F.col("text")), F.lit(END))

    def joined(order: str, text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("at"), text.alias("piece")))), lambda x: x["piece"]), "")

    chunks = steps.groupBy("conv_id", "leaf", "path_rank", F.floor(F.col("dist") / CHUNK).alias("chunk")).agg(joined("dist", piece).alias("part"))
    return chunks.groupBy("conv_id", "leaf", "path_rank").agg(joined("chunk", F.col("part")).alias("formatted"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text, target>>."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|end\|>")), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 2**31 - 1)
        halves = F.split(body, F.lit(r"<\|(?:message|target)\|>"), 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"), F.contains(p, F.lit(TARGET)).alias("target"))

    return F.transform(pieces, turn)


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees of one branch each; equal turns go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    formatted = format_paths(conversations_as_trees(rows.unionByName(extra)), ids_are_unique=True)
    read = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join(F.transform(F.filter("turns", lambda t: t["target"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP5_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss_text,
    sum(length('{START}') + length({_escaped_sql("role")}) + CASE WHEN role = 'assistant' THEN length('{TARGET}') ELSE length('{CONTEXT}') END
        + length({_escaped_sql("text")}) + length('{END}')) AS formatted_chars
  FROM rows WHERE conv_id IS NOT NULL GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text) AS loss_chars, sha256(loss_text) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""
