"""The trie of conversation prefixes.

A turn has a SHA-256 digest of its role and text; a prefix has the digest of the one before it and of its last turn, so equal
digests mean equal sequences. Every prefix of every conversation is one row, and the rows of one (depth, digest) are a node.

The nodes whose smallest member is one conversation are the end of its path: a run that hangs from a node of another
conversation. Sums over a subtree are the sums of the runs in it, so each run is exploded to all ancestors of its first
node, and the nodes within a run add up by a window; that takes a row for each prefix at most, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: The digest of the textless root, and of a list without ids.
EMPTY = hashlib.sha256(b"").digest()
#: Ids that one row of a list of ids holds.
CHUNK = 512


def turn_key(role: Column, text: Column) -> Column:
    """The digest of a turn; the length before the role keeps apart where the role ends."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turn_steps(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, words): the turns of each conversation numbered from 1 by turn, nulls first, equal turns by their key.

    A null role or text counts as empty; rows with a null conv_id belong to no conversation and are left out. Texts stay
    where they are read: only keys and numbers of words go on.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), turn_key(role, text).alias("key"),
                                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).filter("conv_id is not null")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key"))
    return turns.select("conv_id", at.cast("long").alias("at"), "key", "words")


def with_shared_starts(steps: DataFrame, conversations: DataFrame, every: int = 20, starts: int = 4) -> DataFrame:
    """Steps in which each conversation c of (conv_id) begins as conversation c - c % every does.

    Its first h turns, h = crc32(c as text) % starts, are those of that conversation (all if it has fewer, none if it isn't
    there); its own turns after its first h follow. At most starts - 1 turns of one conversation in `every` are joined.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % starts
    first = steps.filter((F.col("conv_id") % every == 0) & (F.col("at") < starts)).withColumnRenamed("conv_id", "first")
    begun = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("first")).join(first, "first").filter(F.col("at") <= h)
    return begun.select("conv_id", "at", "key", "words").unionByName(steps.filter(F.col("at") > h))


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, at, key, words) sorted by conv_id and at, with a step without key first, to one row for each prefix. One digest
    is held at a time, so a conversation may be of any length."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])
    row = None  # not yet known to be the last of its conversation
    for batch in batches:
        out = []
        for conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words"))):
            if row is not None:
                out.append((*row, key is None))
            row = (conv, 0, EMPTY, None, 0) if key is None else (conv, row[1] + 1, hashlib.sha256(row[2] + key).digest(), row[2], words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*row, True), schema)], schema=schema)


def prefixes(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, words, last) of every prefix of every conversation of (conv_id), the empty one first."""
    roots = conversations.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    rows = roots.unionByName(steps).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return rows.mapInArrow(chain, "conv_id long, depth long, digest binary, parent binary, words long, last boolean")


def list_digests(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256): for the (digest, conv_id) rows of a digest the SHA-256 of its ids in order, joined by commas.

    Rows are dealt by ranges of (digest, conv_id), so a list of any length is written by many tasks, in rows of CHUNK ids; one
    task then reads the rows of a list in order and holds one of them at a time, as SHA-256 is sequential.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        digest, held = None, []
        for batch in batches:
            out = []
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (d != digest or len(held) == CHUNK):
                    out.append((digest, held[0], ",".join(map(str, held))))
                    held = []
                digest = d
                held.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((digest, held[0], ",".join(map(str, held))), schema)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
        digest, state = None, None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if d == digest:
                    state.update(b",")
                else:
                    if state:
                        out.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((digest, state.hexdigest()), schema)], schema=schema)

    lists = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(join, "digest binary, first long, ids string")
    return lists.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def parents_of(tops: DataFrame, nodes: DataFrame, attached: DataFrame) -> DataFrame:
    """(digest, parent_conv_id) of the first nodes of runs. A parent to which a thousandth of all runs or more is attached, of which
    there are a thousand at most, is broadcast; the others are joined by their digest."""
    n = attached.agg(F.sum("n_attached")).first()[0] or 0
    owners = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    heavy = attached.filter(F.col("n_attached") >= max(1000, n / 1000)).select("parent")
    found = tops.select("digest", "parent").join(F.broadcast(owners.join(F.broadcast(heavy), "parent")), "parent", "left")
    rest = found.filter("parent_conv_id is null").drop("parent_conv_id").join(owners, "parent")
    return found.filter("parent_conv_id is not null").select("digest", "parent_conv_id").unionByName(rest.select("digest", "parent_conv_id"))


def prefix_trie(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """(digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    steps: (conv_id, at, key, words), as turn_steps gives them; conversations: each conv_id once, also those without a step,
    which are members of the root. conv_id is a node's smallest member and parent_conv_id that of its parent (root: null);
    n_convs counts members, n_children nodes one turn deeper, n_leaves the nodes of its subtree without children, itself
    included; saved_tokens sums (members - 1) * words of the last turn over the subtree; ends_sha256 is of the ids of the
    conversations that end at the node. Without a conversation there is no node.
    """
    with Workspace(conversations.sparkSession, "trie") as space:
        return space.finish(nodes_of(steps, conversations, space))


def nodes_of(steps: DataFrame, conversations: DataFrame, space: Workspace) -> DataFrame:
    """What prefix_trie returns, not yet written; its own tables stand in `space`."""
    paths = space.written(prefixes(steps, conversations), "prefixes")
    # the parent and the words follow from the digest: as keys they cost no sort, as minima they would
    nodes = paths.groupBy("depth", "digest", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    nodes = space.written(nodes.select(
        "digest", "parent", "depth", "conv_id", "n_convs", (F.row_number().over(upwards) == 1).alias("bottom"), F.lead("depth").over(upwards).isNull().alias("top"),
        F.sum((F.col("n_convs") - 1) * F.col("words")).over(upwards.rowsBetween(Window.unboundedPreceding, 0)).alias("saved")), "nodes")
    tops = nodes.filter("top and parent is not null")
    attached = space.written(tops.groupBy("parent").agg(F.count("*").alias("n_attached")), "attached")
    by_digest = attached.select(F.col("parent").alias("digest"), "n_attached")
    ends = nodes.filter("bottom").join(by_digest, "digest", "left").select("conv_id", F.col("n_attached").isNull().cast("long").alias("leaf"))
    runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("first_depth"), F.max("saved").alias("run_saved")).join(ends, "conv_id")
    # a run's leaf counts in all nodes of its conversation's path, its sum in those above the run
    above = paths.select("conv_id", "depth", "digest").join(runs, "conv_id").groupBy("digest").agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("first_depth"), F.col("run_saved")).otherwise(0)).alias("saved_below"))
    rows = nodes.join(above, "digest").join(by_digest, "digest", "left").join(list_digests(paths.filter("last")), "digest", "left").join(parents_of(tops, nodes, attached), "digest", "left")
    own = F.when(~F.col("top"), F.col("conv_id"))
    return rows.select(
        "digest", "conv_id", "depth", F.coalesce(own, "parent_conv_id").alias("parent_conv_id"), "n_convs",
        (F.when(F.col("bottom"), 0).otherwise(1) + F.coalesce("n_attached", F.lit(0))).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + F.col("saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY.hex())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shared_every: int | None = None, shared_starts: int = 4) -> DataFrame:
    """prefix_trie of (conv_id, turn, role, text) rows, with with_shared_starts before it if `shared_every` is given.

    Null and tied turns, null roles and texts and null ids are as turn_steps says; repeated rows are turns of their own; an
    empty table gives no row; other columns are not read.
    """
    steps = turn_steps(conversations)
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    with Workspace(conversations.sparkSession, "trie") as space:
        if shared_every:
            steps = with_shared_starts(space.written(steps, "steps"), ids, shared_every, shared_starts)
        return space.finish(nodes_of(steps, ids, space))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_every=20).drop("digest")


OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM bits WHERE k = 8
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, list_extract(crcs, 1 + xor(c % 256, b)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
), keyed AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL
), steps AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS step FROM keyed
), rebuilt AS (
  SELECT i.conv_id, s.step, s.key, s.words FROM ids i JOIN steps s ON s.conv_id = i.base AND s.step <= i.h
  UNION ALL SELECT i.conv_id, s.step, s.key, s.words FROM ids i JOIN steps s ON s.conv_id = i.conv_id AND s.step > i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, words FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), flagged AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
  SELECT depth, path, left(path, 64 * (depth - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM flagged GROUP BY depth, path
), children AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, path)
), sums AS (
  SELECT p.depth, p.path, sum((s.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((s.n_convs - 1) * s.words)::BIGINT AS saved_tokens
  FROM counted s JOIN paths p ON p.conv_id = s.conv_id AND p.depth <= s.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (depth, path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.parent
"""
