"""The trie of conversation prefixes, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it. A
turn is reduced to a digest and a word count before anything is shuffled, and a node to a key of 16
bytes, the chained SHA-256 of its turns. The smallest member of a node owns it; it then is the smallest
member of every node further down its path, so what a conversation owns is a suffix of its path.

One row stands for each node on each conversation's path. A count by node finds owner and members;
windows over a conversation then mark the nodes it owns, and sum up, from each node down,
the words of nodes it does not own: the words of all occurrences less those of owned ones, which count once. As every
node has one owner, one more group-by on the node sums these into the words that the subtree
saves, the owned next nodes into children, and the conversations that own a leaf into leaves.

Skew: the root and common first turns are nodes of most conversations. Counts and sums combine before
the shuffle; to give rows their node's owner, nodes of more than a HOTth of all rows (fewer than HOT)
are broadcast and the others joined by key. The ids that end at a node are put together
for RUN neighbouring ids each, then hashed as a stream, so no task holds a node's ids.

Defined results: turns are ordered by turn, null first, ties by digest; a null role or text is empty;
rows with a null conv_id take no part; repeated rows are turns of their own; a conversation is held as a sorted
stream, whatever its length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A word, and the key of the root.
WORD, ROOT = r"[^\x20\x09-\x0D]+", bytes(16)
HOT, RUN = 1_000, 4_096
#: The contract's sharing: conversations of EVERY neighbouring ids take fewer than MOST first turns from the first of them.
EVERY, MOST = 20, 4


def turns_of(conversations: DataFrame) -> DataFrame:
    """(block, conv_id, turn, digest, words) of each row; digests tell role and text apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.filter("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % EVERY).alias("block"), "*")


def paths(turns: DataFrame, shared: Column | None = None) -> DataFrame:
    """(block, conv_id, depth, digest, words): a root row and the turns of each conversation, in order.

    shared: how many first turns (fewer than MOST) come from the conversation whose id is the block, in
    place of as many of the conversation's own. Blocks are shuffled once; all windows are within them.
    """
    own, order = Window.partitionBy("block", "conv_id"), [F.col("turn").asc_nulls_first(), "digest"]
    rows = turns.repartition("block").withColumn("n", F.row_number().over(own.orderBy(*order)))
    # at most MOST - 1 turns are collected a block
    first = F.when((F.col("conv_id") == F.col("block")) & (F.col("n") < MOST), F.struct("n", "digest", "words"))
    given = F.array_sort(F.collect_list(first).over(Window.partitionBy("block"))) if shared is not None else F.lit(None)
    rows = rows.withColumns({"given": F.coalesce(given, F.array()).cast("array<struct<depth: bigint, digest: binary, words: bigint>>"), "h": F.lit(0) if shared is None else shared})
    rows = rows.withColumn("given", F.expr("slice(given, 1, h)"))
    depth = (F.size("given") + F.col("n") - F.col("h")).cast("long")
    turn = F.when(F.col("n") > F.col("h"), F.array(F.struct(depth.alias("depth"), "digest", "words"))).otherwise(F.array())
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return rows.select("block", "conv_id", F.inline(F.when(F.col("n") == 1, F.concat(F.array(root), "given", turn)).otherwise(turn)))


def keyed(path: DataFrame) -> DataFrame:
    """(conv_id, depth, key, words, ends) of each node on each path, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha256 = ROOT, hashlib.sha256
        for batch in batches:
            keys = []
            for depth, digest in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist()):
                last = sha256(last + digest).digest()[:16] if depth else ROOT
                keys.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "words", "ends")), pa.array(keys, pa.binary())], ["conv_id", "depth", "words", "ends", "key"])

    ends = F.lead("depth").over(Window.partitionBy("block", "conv_id").orderBy("depth")).isNull()
    rows = path.withColumn("ends", ends).sortWithinPartitions("block", "conv_id", "depth").select("conv_id", "depth", "digest", "words", "ends")
    return common.materialize(rows.mapInArrow(run, "conv_id long, depth long, words long, ends boolean, key binary"), "path-nodes")


def ends_of(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids that end at a node, in ascending order."""
    ends = nodes.filter("ends").groupBy("key", F.shiftright("conv_id", RUN.bit_length() - 1).alias("run"))
    runs = ends.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if own != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _pairs(done)
        if key is not None:
            yield _pairs([(key, sha.hexdigest())])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def trie(path: DataFrame) -> DataFrame:
    """A row for each node of paths(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = keyed(path)
    owners = nodes.groupBy("key").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"), F.count_if("ends").alias("ended"))
    owners = common.materialize(owners.filter("members > 1"), "node-owners")
    # fewer than HOT nodes have more than a HOTth of all rows
    least = nodes.count() / HOT
    hot, rest = F.broadcast(owners.filter(F.col("members") > least)), owners.filter(F.col("members") <= least)
    rows = nodes.join(hot, "key").unionByName(nodes.join(hot.select("key"), "key", "left_anti").join(rest, "key", "left"), allowMissingColumns=True)
    # a node of one member is its own
    rows = rows.withColumns({"owner": F.coalesce("owner", "conv_id"), "childless": F.coalesce(F.col("members") == F.col("ended"), F.col("ends"))})

    conv = Window.partitionBy("conv_id")
    down = conv.orderBy("depth")
    below = conv.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("owned", F.col("owner") == F.col("conv_id"))
    rows = rows.select(
        "conv_id", "depth", "key",
        F.lag("owner").over(down).alias("parent"),
        F.coalesce(F.lead("owned").over(down), F.lit(False)).alias("child"),
        F.max(F.col("owned") & F.col("ends") & F.col("childless")).over(conv).alias("leaf"),
        F.sum(F.when(F.col("owned"), 0).otherwise(F.col("words"))).over(below).alias("saved"),
    )
    found = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if("child").alias("n_children"), F.count_if("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(ends_of(nodes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).drop("key")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(common.read_table(spark, sf_dir, "conversations"))
    return trie(paths(turns, common.crc32_mod("conv_id", MOST).cast("int")))


def _oracle() -> str:
    """Nodes keyed by the digests of their turns put together; every figure by joining a node with its subtree."""
    # the published CRC-32: a byte at a time, eight shifts each
    shift = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(range(0, 8), lambda x, k: {shift}, xor(a, b))"
    crc = f"xor(list_reduce([ord(d)::BIGINT for d in regexp_extract_all(conv_id::VARCHAR, '.')], lambda a, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""WITH o AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM o),
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS n FROM w),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {EVERY} AS block, {crc} % {MOST} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.n, digest, words FROM c JOIN t ON t.conv_id = c.block AND t.n <= c.h
      UNION ALL SELECT c.conv_id, 1, t.n, digest, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS depth FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM d
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT path, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
l AS MATERIALIZED (SELECT n.*, NOT EXISTS (SELECT 1 FROM n m WHERE m.depth = n.depth + 1 AND left(m.path, length(m.path) - 64) = n.path) AS leaf FROM n),
e AS MATERIALIZED (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p WHERE (conv_id, depth) IN (SELECT conv_id, max(depth) FROM p GROUP BY 1) GROUP BY 1)
SELECT u.conv_id, u.depth::BIGINT AS depth, any_value(q.conv_id) AS parent_conv_id, u.n_convs, count(*) FILTER (v.depth = u.depth + 1) AS n_children,
       count(*) FILTER (v.leaf) AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens, sha256(coalesce(any_value(e.ids), '')) AS ends_sha256
FROM l u JOIN l v ON left(v.path, 64 * u.depth) = u.path AND v.depth >= u.depth LEFT JOIN n q ON u.depth = q.depth + 1 AND left(u.path, 64 * q.depth) = q.path LEFT JOIN e ON e.path = u.path
GROUP BY u.conv_id, u.depth, u.path, u.n_convs"""


OP12_SQL = _oracle()
